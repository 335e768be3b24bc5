"""Queries over files: header rows, date orders, routing, sectioned reports; each with its SQL."""

from __future__ import annotations

from talliver.plans.queries import query
from talliver.sources import files


def _texts(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query(
    f"""WITH c AS (SELECT file, line_no, list_filter(list_transform(string_split(lower(line), ','), lambda x: trim(regexp_replace(trim(x), '^"+|"+$', '', 'g'))), lambda x: x <> '') AS cells FROM file_lines WHERE line_no < 30),
n AS (SELECT file, line_no, len(cells) AS n, len(list_filter(cells, lambda x: x IN ({_texts(files.HEADER_CELLS)}))) AS known, len(list_filter(cells, lambda x: regexp_matches(x, '{"|".join(files.HEADER_PARTS)}') AND x NOT IN ({_texts(files.HEADER_CELLS)}))) AS part FROM c)
SELECT file, min(line_no) FILTER (n >= 2 AND known + part >= 2) AS header FROM n GROUP BY file""",
    "file_lines",
)
def i2_find_header_rows(led):
    return files.find_header_rows(led.file_lines)


@query(
    r"""WITH v AS (SELECT file, row, trim(value) AS value, regexp_extract(trim(value), '^(\d{1,4})[/\-.](\d{1,2})[/\-.](\d{2,4})', ['a', 'b', 'c']) AS p FROM file_values WHERE trim(value) <> ''),
q AS (SELECT file, row, CAST(p.a AS INTEGER) AS a, CAST(p.b AS INTEGER) AS b, CAST(p.c AS INTEGER) AS c FROM v WHERE p.a <> '' AND CAST(p.a AS INTEGER) <= 31),
o AS (SELECT file, a, b, lag((c, b, a)) OVER w <= (c, b, a) AS dmy, lag((c, a, b)) OVER w <= (c, a, b) AS mdy FROM q WINDOW w AS (PARTITION BY file ORDER BY row)),
g AS (SELECT file, count(*) FILTER (a > 12) AS a12, count(*) FILTER (b > 12) AS b12, (count(*) FILTER (dmy) - count(*) FILTER (mdy))::DOUBLE / greatest(count(*) - 1, 1) AS apart, count(DISTINCT a) AS ua, count(DISTINCT b) AS ub FROM o GROUP BY file),
s AS (SELECT file, count(*) AS n, count(*) FILTER (regexp_matches(value, '[A-Za-z]{3,}')) AS named, count(*) FILTER (regexp_matches(value, '^\d{4}[/\-]')) AS iso FROM v GROUP BY file),
e AS (SELECT *, CASE WHEN n IS NULL THEN 'no value' WHEN named > 0.8 * n THEN 'named month' WHEN iso > 0.8 * n THEN 'year first' WHEN a12 IS NULL THEN 'no numeric value' WHEN (a12 > 0) <> (b12 > 0) THEN 'part above 12'
 WHEN a12 > 0 THEN 'parts above 12' WHEN abs(apart) > 0.15 THEN 'order' WHEN ua <> ub THEN 'distinct numbers' ELSE 'default' END AS evidence FROM (SELECT DISTINCT file FROM file_values) LEFT JOIN s USING (file) LEFT JOIN g USING (file))
SELECT file, evidence, CASE evidence WHEN 'named month' THEN FALSE WHEN 'year first' THEN FALSE WHEN 'part above 12' THEN a12 > 0 WHEN 'parts above 12' THEN a12 >= b12 WHEN 'order' THEN apart > 0 WHEN 'distinct numbers' THEN ua > ub ELSE TRUE END AS day_first,
 CASE WHEN evidence IN ('named month', 'year first', 'part above 12') THEN 'high' WHEN evidence IN ('parts above 12', 'order') THEN 'medium' ELSE 'low' END AS confidence FROM e""",
    "file_values",
)
def i4_detect_date_order(led):
    return files.detect_date_order(led.file_values)


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda x: length(x) >= 3))"


@query(
    f"""WITH a AS (SELECT user_id, account_id, {_TOKENS.format("w")} AS own FROM (SELECT user_id, account_id, unnest([name, institution]) AS w FROM named_accounts)),
u AS (SELECT file, user_id, lower(text) AS text, {_TOKENS.format("text")} AS held FROM uploads),
s AS (SELECT file, account_id, least(1.0::DOUBLE, round(max(len(list_intersect(own, held))::DOUBLE / len(own) + CASE WHEN len(list_filter(own, lambda x: length(x) >= 5 AND contains(text, x))) > 0 THEN 0.2::DOUBLE ELSE 0 END), 9)) AS score
 FROM u JOIN a USING (user_id) WHERE len(own) > 0 GROUP BY file, account_id),
r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY file ORDER BY score DESC, account_id)),
v AS (SELECT file, account_id, coalesce(score, 0) AS score, CASE WHEN coalesce(score, 0) < 0.4 THEN 'none' WHEN coalesce(second >= 0.85::DOUBLE * score, FALSE) THEN 'ambiguous' ELSE 'routed' END AS verdict FROM u LEFT JOIN (SELECT * FROM r WHERE n = 1) USING (file))
SELECT file, CASE WHEN verdict = 'routed' THEN account_id END AS account_id, score, verdict FROM v""",
    "named_accounts uploads",
)
def i7_route_files(led):
    return files.route_files(led.uploads, led.named_accounts)


@query(
    """SELECT o.o_custkey AS file, concat('S', l.l_partkey) AS symbol, CAST(CAST(l.l_shipdate AS DATE) AS TIMESTAMP) AS trade_date, CAST(CAST(l.l_quantity AS INTEGER) AS DOUBLE) AS quantity, -CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS proceeds
 FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_linenumber % 4 <> 0 AND l.l_linenumber % 5 <> 1"""
)
def i8_sectioned_trades(led):
    """Trades written as report lines and read back."""
    return files.read_sectioned_report(led.report_lines)["trades"].select("file", "symbol", "trade_date", "quantity", "proceeds")
