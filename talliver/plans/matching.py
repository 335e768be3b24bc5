"""Queries of wording, categories, schedules and interest, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from talliver.functions import text
from talliver.operators import balances as B
from talliver.operators import categorise, pairs, settle, spend
from talliver.operators import ledger_jobs as jobs
from talliver.plans.queries import _ALL, _TWO_DAYS, AS_OF, balances_sql, dates, found_balances, query

_NORM = r"regexp_replace(lower(trim(coalesce({0}, ''))), '\s+', ' ', 'g')"
_KEY = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '(?:\d{{1,2}}[/\-.]\d{{1,2}}[/\-.]\d{{2,4}}|\d{{4}}[/\-.]\d{{1,2}}[/\-.]\d{{1,2}})', ' ', 'g'), '[^a-zA-Z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')))"
_RATIO = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - CAST(levenshtein({0}, {1}) AS DOUBLE) / greatest(length({0}), length({1})) END"
_BARE = _NORM.format("{0}")
for _noise in text.PATTERN_NOISE:
    _BARE = f"regexp_replace({_BARE}, '{_noise.replace('{', '{{').replace('}', '}}')}', '', 'g')"
_BARE = rf"trim(regexp_replace({_BARE}, '\s+', ' ', 'g'))"


def _cut(column: str) -> str:
    bare = _BARE.format(column)
    return f"CASE WHEN length({bare}) > 60 THEN regexp_replace(substr({bare}, 1, 60), ' [^ ]*$', '') ELSE {bare} END"


@query(f"SELECT DISTINCT description, {_cut('description')} AS pattern, {_NORM.format('description')} AS norm FROM moves", "moves")
def x3_extract_pattern(led):
    d = F.col("description")
    return led.moves.select("description").distinct().select("description", text.extract_pattern(d).alias("pattern"), text.normalised(d).alias("norm"))


_RULES = f"""lr AS (SELECT pattern, user_id, category_id, hits FROM (SELECT *, count(*) OVER (PARTITION BY pattern, user_id) AS hits, row_number() OVER (PARTITION BY pattern, user_id ORDER BY ts DESC, txn_id DESC) AS n
 FROM (SELECT *, {_cut("description")} AS pattern FROM moves WHERE txn_id % 3 = 0 AND txn_id % 10 < 7) WHERE pattern <> '') WHERE n = 1)"""


def _rules(led):
    return categorise.learn_patterns(led.moves.filter("txn_id % 3 = 0 and txn_id % 10 < 7"))


@query(f"WITH {_RULES} SELECT * FROM lr", "moves")
def c2_learn_patterns(led):
    return _rules(led)


#: (priority, keyword, sign, category): a caller's list.
KEYWORDS = ((1, "salary", "in", 100), (2, "refund", "in", 101), (3, "lidl", "any", 102), (4, "uber eats", "any", 103), (5, "uber", "any", 104), (6, "netflix", "any", 105), (7, "payment thank you", "out", 106))
_KEYWORD_ROWS = ", ".join(f"({p}, '{w}', '{s}', {c})" for p, w, s, c in KEYWORDS)
_RULED = f"""{_RULES}, tx AS (SELECT DISTINCT {_NORM.format("description")} AS norm FROM moves),
tw AS (SELECT norm, list_filter(string_split(norm, ' '), lambda x: length(x) >= 3) AS words FROM tx), rw AS (SELECT *, list_filter(string_split(pattern, ' '), lambda x: length(x) >= 3) AS words FROM lr),
rm AS (SELECT norm, category_id, pattern, contains(norm, pattern) AS inside, row_number() OVER (PARTITION BY norm ORDER BY hits DESC, pattern, user_id) AS n FROM tw JOIN rw
 ON contains(norm, pattern) OR (len(rw.words) >= 2 AND 4 * len(list_filter(rw.words, lambda x: list_contains(tw.words, x))) >= 3 * len(rw.words)))"""


@query(
    f"""WITH {_RULED}, kw(priority, keyword, sign, category_id) AS (VALUES {_KEYWORD_ROWS}),
mm AS (SELECT txn_id, {_NORM.format("description")} AS norm, CASE WHEN amount >= 0 THEN 'in' WHEN amount < 0 THEN 'out' ELSE 'none' END AS way FROM moves),
km AS (SELECT norm, way, category_id, row_number() OVER (PARTITION BY norm, way ORDER BY sign = 'any', priority) AS n FROM (SELECT DISTINCT norm, way FROM mm) JOIN kw ON contains(norm, keyword) AND (sign = 'any' OR sign = way))
SELECT txn_id, coalesce(rm.category_id, km.category_id) AS category_id, CASE WHEN rm.norm IS NOT NULL THEN 'rule' WHEN km.norm IS NOT NULL THEN 'keyword' ELSE 'none' END AS tier
FROM mm LEFT JOIN rm ON rm.norm = mm.norm AND rm.n = 1 LEFT JOIN km ON km.norm = mm.norm AND km.way = mm.way AND km.n = 1""",
    "moves",
)
def c1_categorise_x13_x14(led):
    words = led.spark.createDataFrame(list(KEYWORDS), "priority int, keyword string, sign string, category_id long")
    return categorise.categorise(led.moves, _rules(led), words)


@query(
    f"""WITH {_RULES}, nn AS (SELECT txn_id, {_NORM.format("description")} AS norm FROM moves WHERE category_id = 4)
SELECT txn_id, category_id FROM (SELECT txn_id, lr.category_id, row_number() OVER (PARTITION BY txn_id ORDER BY hits DESC, pattern, user_id) AS n FROM nn JOIN lr ON contains(norm, pattern)) WHERE n = 1""",
    "moves",
)
def c3_apply_rule_history(led):
    rows = led.moves.withColumn("category_id", F.when(F.col("category_id") != 4, F.col("category_id")))
    return categorise.apply_rule_history(rows, _rules(led))


def _wording(a: str, b: str) -> str:
    refs = "list_sort(list_distinct(regexp_extract_all({0}, '\\d{{4,}}')))"
    ra, rb = refs.format(a), refs.format(b)
    short, long = (f"CASE WHEN length({a}) <= length({b}) THEN {x} ELSE {y} END" for x, y in ((a, b), (b, a)))
    bare = lambda x: f"replace({x}, ' ', '')"
    return f"""({a} <> '' AND NOT (len({ra}) > 0 AND len({rb}) > 0 AND {ra} <> {rb}) AND ((length({short}) >= 12 AND starts_with({long}, {short}))
 OR (length({bare(short)}) >= 8 AND contains({bare(long)}, {bare(short)})) OR {_RATIO.format(a, b)} >= 0.85))"""


def _layers(name: str, where: str) -> str:
    return f"""{name} AS (SELECT txn_id, account_id, CAST(ts AS DATE) AS day, amount, description, {_KEY.format("description")} AS key,
 sha256(account_id || chr(31) || raw || chr(31) || (row_number() OVER (PARTITION BY account_id, raw ORDER BY txn_id) - 1)) AS hash
 FROM (SELECT *, CASE WHEN raw_data LIKE '{{%' THEN array_to_string(list_transform(list_sort(json_keys(raw_data)), lambda k: concat(trim(k), '=', trim(json_extract_string(raw_data, concat('$.', k))))), chr(30)) END AS raw FROM moves WHERE {where}))"""


_SAME = "o.account_id = n.account_id AND o.day = n.day AND o.amount = n.amount"


def _known(table: str, words: tuple[str, str, str]) -> str:
    return f"""WHEN EXISTS (SELECT 1 FROM {table} o WHERE o.hash = n.hash) THEN '{words[0]}' WHEN EXISTS (SELECT 1 FROM {table} o WHERE {_SAME} AND lower(trim(o.description)) = lower(trim(n.description))) THEN '{words[1]}'
 WHEN EXISTS (SELECT 1 FROM {table} o WHERE {_SAME} AND {_wording("n.key", "o.key")}) THEN '{words[2]}'"""


@query(
    f"""WITH {_layers("n", "txn_id % 2 = 1")}, {_layers("l", "txn_id % 4 = 0")}, {_layers("d", "txn_id % 4 = 2")}
SELECT txn_id, account_id, CASE {_known("l", ("same_row", "duplicate", "near_duplicate"))} {_known("d", ("deleted_row", "deleted", "near_deleted"))} ELSE 'imported' END AS outcome FROM n""",
    "moves",
)
def j10_dedupe_by_layers_x6(led):
    part = lambda c: led.moves.filter(c)
    return jobs.dedupe_by_layers(part("txn_id % 2 = 1"), part("txn_id % 4 = 0"), part("txn_id % 4 = 2"), text.ratio_by_edits)


@query()
def j10_dedupe_by_layers_x7(led):
    part = lambda c: led.moves.filter(c)
    return jobs.dedupe_by_layers(part("txn_id % 2 = 1"), part("txn_id % 4 = 0"), part("txn_id % 4 = 2"))


@query()
def j9_near_duplicates_x7(led):
    return pairs.near_duplicates(led.moves)


_LIKE = f"greatest({_RATIO.format('lower(m.description)', 'lower(s.description)')}, {_RATIO.format(_KEY.format('m.description'), _KEY.format('s.description'))})"
_GROUP = r"lower(trim(regexp_replace(regexp_replace(regexp_replace({0}, '\d+', '', 'g'), '[^a-zA-Z\s]', ' ', 'g'), '\s+', ' ', 'g')))"
_LAST = "CASE s.last_text WHEN 0 THEN 'ACH PAYMENT thank you' WHEN 10 THEN 'Direct Debit council tax' END"


def _dues(led):
    last = F.when(F.col("last_text") == 0, "ACH PAYMENT thank you").when(F.col("last_text") == 10, "Direct Debit council tax")
    return led.dues.withColumn("last_text", last)


@query(
    f"""WITH p AS (SELECT txn_id, payment_id, abs(date_diff('day', CAST(ts AS DATE), next_due)) AS gap, CAST(m.amount AS DOUBLE) AS a, CAST(s.amount AS DOUBLE) AS d, is_asset, {_LIKE} AS text_score,
 CASE WHEN {_GROUP.format(_LAST)} = {_GROUP.format("m.description")} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS history FROM moves m JOIN dues s ON m.account_id = s.account_id AND abs(date_diff('day', CAST(ts AS DATE), next_due)) <= 12),
o AS (SELECT *, CASE WHEN is_asset THEN abs(a - d) / abs(d) ELSE least(abs(a - d) / abs(d), abs(a + d) / abs(d)) END AS off FROM p),
q AS (SELECT *, CASE WHEN off <= 0.005::DOUBLE THEN 1.0::DOUBLE WHEN off >= 0.15::DOUBLE THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - (off - 0.005::DOUBLE) / 0.145::DOUBLE END AS amount_score, CASE WHEN gap <= 1 THEN 1.0::DOUBLE WHEN gap >= 12 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - (gap - 1) / 11.0::DOUBLE END AS date_score FROM o),
t AS (SELECT *, round(0.5::DOUBLE * amount_score + 0.25::DOUBLE * date_score + 0.15::DOUBLE * text_score + 0.1::DOUBLE * history, 6) AS score FROM q)
SELECT txn_id, payment_id, amount_score, date_score, text_score, history, score, CASE WHEN score >= 0.8 THEN 'settles' ELSE 'proposed' END AS decision FROM t WHERE score >= 0.55""",
    "moves dues",
)
def x10_match_scores_j14(led):
    return settle.match_scores(led.moves, _dues(led), text.edit_similarity)


# Rows choose in the order of their time; a schedule that is taken is no choice of later rows.
_IN_ORDER = """c AS (SELECT account_id, txn_id, ts, list({'p': payment_id, 'gap': gap, 'score': score} ORDER BY score DESC, payment_id) AS cands FROM p GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ts, txn_id) AS i FROM c),
f AS (SELECT account_id, 0::BIGINT AS i, NULL::BIGINT AS txn_id, NULL::STRUCT(p BIGINT, gap INTEGER, score DOUBLE) AS best, []::BIGINT[] AS taken FROM (SELECT DISTINCT account_id FROM o)
 UNION ALL SELECT account_id, i, txn_id, best, CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best.p) END FROM (
  SELECT o.account_id, o.i, o.txn_id, f.taken, list_filter(o.cands, lambda x: NOT list_contains(f.taken, x.p))[1] AS best FROM f JOIN o ON o.account_id = f.account_id AND o.i = f.i + 1))"""


@query(
    f"""WITH RECURSIVE p AS (SELECT account_id, txn_id, ts, payment_id, gap, l * (1.0::DOUBLE - gap / 6.0::DOUBLE) AS score FROM (
 SELECT m.account_id, txn_id, ts, payment_id, CAST(abs(date_diff('day', CAST(ts AS DATE), next_due)) AS INTEGER) AS gap, CASE WHEN payment_id % 5 = 0 THEN greatest({_LIKE}, 0.4::DOUBLE) ELSE {_LIKE} END AS l
 FROM moves m JOIN dues s ON m.account_id = s.account_id AND abs(date_diff('day', CAST(ts AS DATE), next_due)) <= 5
 WHERE abs(m.amount - s.amount) / abs(s.amount) <= 0.05 OR (NOT is_asset AND abs(m.amount + s.amount) / abs(s.amount) <= 0.05)) WHERE l >= 0.4),
{_IN_ORDER}
SELECT txn_id, best.p AS payment_id, best.gap AS gap, best.score AS score FROM f WHERE best IS NOT NULL""",
    "moves dues",
)
def j13_gated_matches(led):
    return settle.gated_matches(led.moves, led.dues.withColumn("variable", F.expr("payment_id % 5 = 0")), text.edit_similarity)


@query()
def j14_settle_backlog(led):
    frequency = F.expr("case payment_id % 3 when 0 then 'weekly' when 1 then 'monthly' else 'once' end")
    schedules = _dues(led).drop("last_text").withColumn("frequency", frequency).withColumn("day_of_month", F.when(F.col("payment_id") % 2 == 0, F.dayofmonth("next_due")))
    return settle.settle_backlog(led.moves, schedules, "2024-01-01")


@query(
    """WITH RECURSIVE a AS (SELECT account_id FROM accounts WHERE account_type IN ('mortgage', 'credit_card')),
s AS (SELECT account_id, CAST(date_trunc('month', ts) AS DATE) AS month, sum(amount) AS moved FROM transactions JOIN a USING (account_id) GROUP BY 1, 2),
done AS (SELECT DISTINCT account_id, CAST(date_trunc('month', ts) AS DATE) AS month FROM transactions WHERE txn_id % 10 = 0),
f AS (SELECT account_id, min(month) AS first FROM s GROUP BY 1),
g AS (SELECT account_id, CAST(x AS DATE) AS month, row_number() OVER (PARTITION BY account_id ORDER BY x) AS i FROM f, unnest(generate_series(CAST(first AS TIMESTAMP), TIMESTAMP '2001-06-01', INTERVAL 1 MONTH)) u(x)),
m AS (SELECT g.account_id, g.month, g.i, coalesce(s.moved, 0) AS moved, d.month IS NOT NULL AS done FROM g LEFT JOIN s USING (account_id, month) LEFT JOIN done d USING (account_id, month)),
r AS (SELECT account_id, 0::BIGINT AS i, CAST(0 AS DECIMAL(24,2)) AS balance, CAST(0 AS DECIMAL(24,2)) AS interest, CAST(NULL AS DATE) AS month FROM f
 UNION ALL SELECT account_id, i, CAST(b + n AS DECIMAL(24,2)), n, month FROM (SELECT account_id, i, month, b, CAST(CASE WHEN done THEN 0 ELSE round(abs(b) * CAST(0.005 AS DECIMAL(8,4)), 2) * sign(b) END AS DECIMAL(24,2)) AS n
 FROM (SELECT m.account_id, m.i, m.month, m.done, CAST(r.balance + m.moved AS DECIMAL(24,2)) AS b FROM r JOIN m ON m.account_id = r.account_id AND m.i = r.i + 1)))
SELECT account_id, month, CAST(interest AS DECIMAL(38,2)) AS interest FROM r WHERE interest <> 0""",
    "accounts transactions",
)
def x20_accrue_interest(led):
    owed = led.accounts.filter("account_type in ('mortgage', 'credit_card')").select("account_id", F.lit("0.005").cast("decimal(12,10)").alias("monthly_rate"))
    posted = led.transactions.filter("txn_id % 10 = 0").select("account_id", F.date_trunc("month", "ts").cast("date").alias("month"))
    return settle.accrue_interest(led.transactions, owed, AS_OF, posted)


@query("SELECT txn_id, split_no, CASE WHEN txn_id % 3 = 0 THEN amount_native ELSE CAST(amount_native * 2 AS DECIMAL(18,2)) END AS effective FROM splits", "splits")
def f6_effective_amount(led):
    rows = led.splits.withColumn("amount_base", F.when(F.col("txn_id") % 3 != 0, (F.col("amount_native") * 2).cast("decimal(18,2)")))
    return rows.select("txn_id", "split_no", spend.effective_amount().alias("effective"))


@query(
    balances_sql(_TWO_DAYS)
    + """SELECT as_of, CASE WHEN is_asset THEN 'asset' ELSE 'liability' END AS side, CASE account_type WHEN 'checking' THEN 'Banking' WHEN 'credit_card' THEN 'Credit Cards' WHEN 'brokerage' THEN 'Investments & Retirement' WHEN 'real_estate' THEN 'Real Estate' ELSE 'Loans' END AS type_group,
 count(*) AS n, CAST(abs(sum(CAST(coalesce(round(value_base * 100), 0.0) AS BIGINT))) AS BIGINT) AS total FROM bal GROUP BY GROUPING SETS ((1, 2, 3), (1, 2))""",
    _ALL,
)
def a15_balance_sheet(led):
    return B.balance_sheet(found_balances(led, dates(led, "1999-12-31", AS_OF)))


@query(
    """WITH g AS (SELECT account_id, CAST(ts AS DATE) AS day, amount FROM feed GROUP BY 1, 2, 3 HAVING count(*) >= 2),
n AS (SELECT a.txn_id AS a, b.txn_id AS b FROM feed a JOIN feed b ON a.account_id = b.account_id AND a.amount = b.amount AND a.import_batch_id <> b.import_batch_id AND date_diff('day', CAST(a.ts AS DATE), CAST(b.ts AS DATE)) BETWEEN 1 AND 3
 WHERE 1.0::DOUBLE - CAST(levenshtein(a.description, b.description) AS DOUBLE) / greatest(length(a.description), length(b.description)) >= 0.85)
SELECT f.txn_id FROM feed f JOIN g ON g.account_id = f.account_id AND g.day = CAST(f.ts AS DATE) AND g.amount = f.amount UNION SELECT a FROM n UNION SELECT b FROM n""",
    "feed",
)
def u2_group_members_union(led):
    near = pairs.near_duplicates(led.feed, similarity=lambda a, b: text.ratio_by_edits(F.lower(a), F.lower(b)))
    return pairs.group_members(led.feed, pairs.duplicate_groups(led.feed), near)


@query(
    """WITH g AS (SELECT account_id, CAST(ts AS DATE) AS day, amount, count(*) AS n, count(DISTINCT import_batch_id) > 1 AS cross_batch, min(txn_id) AS first_id FROM feed GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT account_id, first_id, cross_batch, n, CAST(row_number() OVER (PARTITION BY account_id ORDER BY cross_batch DESC, n DESC, first_id) AS INTEGER) AS place FROM g""",
    "feed",
)
def k4_rank_candidates(led):
    return pairs.ranked_groups(pairs.duplicate_groups(led.feed)).select("account_id", "first_id", "cross_batch", "n", "place")
