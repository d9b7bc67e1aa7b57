"""Layer reports.

`pages` is parsed as it is, with lists for tables. `lineitem` is turned into
one small report per line, so that the expected tables follow from its columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from framewright.operators import reports as R
from framewright.session import materialize, shared_folder
from framewright.sources.reports import reports_from_table, scan_html_reports, write_report
from workload.registry import query, spread_table, table

LAYERS = R.LAYERS
PARTS = ("Name", *R.METRIC_CELLS)


def _tr(*cells) -> F.Column:
    parts = []
    for cell in cells:
        parts += [F.lit("<td>"), cell, F.lit("</td>")]
    return F.concat(F.lit("<tr>"), *parts, F.lit("</tr>\n"))


def line_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per line: a header, three layer rows, one other row."""
    line = spread_table(spark, sf_dir, "lineitem").select(
        *[F.col(c).cast("bigint").alias(c) for c in
          ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")],
        "l_returnflag", "l_linestatus",
    )
    rest = (F.col("l_orderkey") % 50).cast("string")
    qty, part, supp = F.col("l_quantity"), F.col("l_partkey"), F.col("l_suppkey")

    def name(layer):
        return F.concat(F.lit("\n  <b>enc_layers_"), layer, F.lit("_attentions_0."), rest, F.lit("</b>&nbsp;"))

    kind = F.when(F.col("l_linestatus") == "F", "conv &amp; relu").otherwise("conv")
    bits = F.lit('<a title="8 > 4">int8</a>')
    own, following = F.col("l_linenumber") - 1, F.col("l_linenumber") % 7
    html = F.concat(
        F.lit("<html><!-- <tr><td>no row</td></tr> --><table class='q'>"),
        F.lit("<tr><th>Name</th><th>Kind</th></tr>"),
        _tr(name(own), kind, bits, part, supp, qty),
        F.when(F.col("l_returnflag") == "R", _tr(name(own), kind, bits, supp, part)).otherwise(
            _tr(name(own), kind, bits, supp, part, qty)
        ),
        _tr(name(following), kind, bits, qty, qty + 1, qty + 2),
        _tr(F.concat(F.lit("head."), rest), kind, bits, part, part, part),
        F.lit("</table></html>"),
    )
    path = F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"
    )
    return line.select(path.alias("path"), html.alias("html"))


def line_cells(spark, sf_dir):
    return R.table_cells(line_reports(spark, sf_dir))


def line_layers(spark, sf_dir):
    return R.layer_rows(line_reports(spark, sf_dir))


PAGE_ROWS = r"""
p AS (SELECT page_id, regexp_extract_all(
          regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'),
          '(?is)<ul\b[^>]*>(.*?)</ul\s*>', 1) AS bodies FROM pages),
u AS (SELECT page_id, unnest(range(0, len(bodies)))::INT AS row_no, unnest(bodies) AS row_html FROM p)"""
PAGE_CELLS = PAGE_ROWS + r""",
c AS (SELECT page_id, row_no,
             list_transform(regexp_extract_all(row_html, '(?is)<li\b[^>]*>(.*?)</li\s*>', 1),
                            lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'))) AS cells FROM u)"""
# what the reports above must say, straight from the columns
ROWS = """
k AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
             || l_quantity::BIGINT || '-' || l_returnflag || '-' || l_linestatus AS path,
             l_linenumber - 1 AS own, l_linenumber % 7 AS following, l_orderkey % 50 AS rest,
             l_partkey AS p, l_suppkey AS s, l_quantity::BIGINT AS q, l_returnflag = 'R' AS short,
             CASE l_linestatus WHEN 'F' THEN 'conv & relu' ELSE 'conv' END AS kind
      FROM lineitem),
e AS (SELECT path, kind, 1 AS row_no, own AS layer, rest, p AS c3, s AS c4, q AS c5, 6 AS n FROM k
      UNION ALL SELECT path, kind, 2, own, rest, s, p, CASE WHEN short THEN NULL ELSE q END,
                       CASE WHEN short THEN 5 ELSE 6 END FROM k
      UNION ALL SELECT path, kind, 3, following, rest, q, q + 1, q + 2, 6 FROM k
      UNION ALL SELECT path, kind, 4, NULL, rest, p, p, p, 6 FROM k),
t AS (SELECT path, kind, row_no, n, layer, rest,
             CASE WHEN layer IS NULL THEN 'head.' || rest
                  ELSE 'enc_layers_' || layer || '_attentions_0.' || rest END AS name,
             'enc_layers__attentions_0.' || rest AS common,
             c3::VARCHAR AS cos, c4::VARCHAR AS sqnr, c5::VARCHAR AS mse FROM e)"""
METRICS = 'cos AS "Cosine Similarity", sqnr AS "SQNR", mse AS "MSE"'
MATCHED = "FROM t WHERE layer IS NOT NULL"


def _wide_sql(group: str, keys: str, order: str) -> str:
    """Last row per group and layer, then one column group per layer."""
    columns = ", ".join(
        f'max(CASE WHEN layer = {i} THEN {value} END) AS "Layer {i} {part}"'
        for i in LAYERS
        for part, value in zip(PARTS, ("name", "cos", "sqnr", "mse"))
    )
    return f"""WITH {ROWS},
    last AS (SELECT *, row_number() OVER (PARTITION BY {group}, layer ORDER BY {order}) AS back {MATCHED})
    SELECT {keys}common AS "Common Layer Name", {columns} FROM last WHERE back = 1 GROUP BY {group}"""


@query(
    "reports_from_table",
    "SELECT page_id AS path, length(html)::INT AS n_chars, md5(html) AS digest FROM pages",
)
def q_reports_from_table(spark, sf_dir):
    docs = reports_from_table(spread_table(spark, sf_dir, "pages"), "page_id", "html")
    return docs.select("path", F.length("html").alias("n_chars"), F.md5("html").alias("digest"))


@query("scan_html_reports", f"WITH {PAGE_ROWS} SELECT row_html FROM u")
def q_scan_html_reports(spark, sf_dir):
    """The pages written as report files, each of many pages, and their rows read back from the files."""
    path = f"{shared_folder(spark)}/framewright/reports-{uuid.uuid4().hex}"
    table(spark, sf_dir, "pages").select("html").write.text(path)
    return R.extract_table_rows(scan_html_reports(spark, path), row_tag="ul").select("row_html")


@query("extract_table_rows", f"WITH {PAGE_ROWS} SELECT page_id, row_no, row_html FROM u")
def q_extract_table_rows(spark, sf_dir):
    return R.extract_table_rows(spread_table(spark, sf_dir, "pages"), ["page_id"], row_tag="ul")


@query(
    "extract_row_cells",
    f"""WITH {PAGE_CELLS} SELECT page_id, row_no, unnest(range(0, len(cells)))::INT AS cell_no,
        unnest(cells) AS cell FROM c""",
)
def q_extract_row_cells(spark, sf_dir):
    rows = R.extract_table_rows(spread_table(spark, sf_dir, "pages"), ["page_id"], row_tag="ul")
    cells = R.extract_row_cells(rows, cell_tag="li")
    return cells.select("page_id", "row_no", F.posexplode("cells").alias("cell_no", "cell"))


@query(
    "extract_cells_tolerant",
    f"""WITH {PAGE_CELLS} SELECT page_id, row_no, unnest(range(0, len(cells)))::INT AS cell_no,
        unnest(cells) AS cell FROM c""",
)
def q_extract_cells_tolerant(spark, sf_dir):
    cells = R.extract_cells_tolerant(
        spread_table(spark, sf_dir, "pages"), ["page_id"], row_tag="ul", cell_tag="li"
    )
    return cells.select("page_id", "row_no", F.posexplode("cells").alias("cell_no", "cell"))


@query("filter_nonempty_rows", f"WITH {ROWS} SELECT path, row_no, n AS n_cells, name, kind FROM t")
def q_filter_nonempty_rows(spark, sf_dir):
    rows = R.filter_nonempty_rows(line_cells(spark, sf_dir))
    return rows.select(
        "path", "row_no", F.size("cells").alias("n_cells"),
        R.layer_name().alias("name"), R.optional_cell(1).alias("kind"),
    )


@query("filter_layer_rows", f"WITH {ROWS} SELECT path, row_no, name {MATCHED}")
def q_filter_layer_rows(spark, sf_dir):
    rows = R.filter_layer_rows(R.filter_nonempty_rows(line_cells(spark, sf_dir)))
    return rows.select("path", "row_no", R.layer_name().alias("name"))


@query("filter_layer_contains", f"WITH {ROWS} SELECT path, row_no, name FROM t WHERE layer = 3")
def q_filter_layer_contains(spark, sf_dir):
    rows = R.filter_layer_contains(line_cells(spark, sf_dir), R.LAYER_LITERAL.format(i=3))
    return rows.select("path", "row_no", R.layer_name().alias("name"))


@query(
    "parse_layer_name",
    f"""WITH {ROWS} SELECT path, row_no, 'enc_layers_' AS prefix, layer::VARCHAR AS layer,
        '_attentions_0' AS suffix, '.' || rest AS rest {MATCHED}""",
)
def q_parse_layer_name(spark, sf_dir):
    rows = R.parse_layer_name(R.filter_layer_rows(line_cells(spark, sf_dir)))
    return rows.select("path", "row_no", "prefix", "layer", "suffix", "rest")


@query("common_layer_name", f"WITH {ROWS} SELECT path, row_no, common {MATCHED}")
def q_common_layer_name(spark, sf_dir):
    rows = R.parse_layer_name(R.filter_layer_rows(line_cells(spark, sf_dir)))
    return rows.select("path", "row_no", R.common_layer_name().alias("common"))


@query("full_layer_name", f"WITH {ROWS} SELECT path, row_no, name {MATCHED}")
def q_full_layer_name(spark, sf_dir):
    rows = R.parse_layer_name(R.filter_layer_rows(line_cells(spark, sf_dir)))
    return rows.select("path", "row_no", R.full_layer_name().alias("name"))


@query("optional_cell", f"WITH {ROWS} SELECT path, row_no, {METRICS} FROM t")
def q_optional_cell(spark, sf_dir):
    rows = R.filter_nonempty_rows(line_cells(spark, sf_dir))
    return rows.select("path", "row_no", *R.metric_cells("null"))


@query("required_cell", f"WITH {ROWS} SELECT path, row_no, cos AS c3, sqnr AS c4 FROM t")
def q_required_cell(spark, sf_dir):
    rows = R.filter_nonempty_rows(line_cells(spark, sf_dir))
    return rows.select(
        "path", "row_no", R.required_cell(3).alias("c3"), R.required_cell(4).alias("c4")
    )


@query(
    "layer_name_prefix",
    f"WITH {ROWS} SELECT path, row_no, CASE WHEN layer = 0 THEN 'enc_' ELSE name END AS prefix FROM t",
)
def q_layer_name_prefix(spark, sf_dir):
    rows = R.filter_nonempty_rows(line_cells(spark, sf_dir))
    return rows.select("path", "row_no", R.layer_name_prefix(R.LAYER_LITERAL.format(i=0)).alias("prefix"))


@query(
    "ordered_columns",
    f"""WITH {ROWS} SELECT common AS "Common Layer Name", {", ".join(
        f'CASE WHEN layer = {i} THEN {v} END AS "Layer {i} {p}"'
        for i in LAYERS for p, v in zip(PARTS, ("name", "cos", "sqnr", "mse")))} {MATCHED}""",
)
def q_ordered_columns(spark, sf_dir):
    return R.ordered_columns(R.layer_sparse_report(line_layers(spark, sf_dir)))


@query("layer_wide_report", _wide_sql("path, common", "path, ", "row_no DESC"))
def q_layer_wide_report(spark, sf_dir):
    return R.layer_wide_report(line_layers(spark, sf_dir))


@query("layer_wide_report_merged", _wide_sql("common", "", "path DESC, row_no DESC"))
def q_layer_wide_report_merged(spark, sf_dir):
    return R.layer_wide_report(line_layers(spark, sf_dir), group=(), order=("path", "row_no"))


@query(
    "layer_sparse_report",
    f"""WITH {ROWS} SELECT path, row_no, common AS "Common Layer Name", {", ".join(
        f'CASE WHEN layer = {i} THEN {v} END AS "Layer {i} {p}"'
        for i in LAYERS for p, v in zip(PARTS, ("name", "cos", "sqnr", "mse")))} {MATCHED}""",
)
def q_layer_sparse_report(spark, sf_dir):
    return R.layer_sparse_report(line_layers(spark, sf_dir))


LONG = f"""WITH {ROWS} SELECT path, row_no, name AS "Layer Name", {METRICS},
    'layer_' || layer || '_attention_0' AS "Attention Layer" FROM t WHERE layer <= 4"""


@query("layer_long_report", LONG)
def q_layer_long_report(spark, sf_dir):
    return R.layer_long_report(line_cells(spark, sf_dir))


@query(
    "layer_prefix_report",
    f"""WITH {ROWS} SELECT path, row_no, 'enc_' AS "Layer Name", {METRICS} FROM t WHERE layer = 0""",
)
def q_layer_prefix_report(spark, sf_dir):
    return R.layer_prefix_report(line_cells(spark, sf_dir))


@query("union_layers", LONG)
def q_union_layers(spark, sf_dir):
    cells = materialize(line_cells(spark, sf_dir), "cells", compression="zstd")  # parsed once, read by every part
    return R.union_layers([R.layer_long_report(cells, layers=[i]) for i in LAYERS])


@query("write_report", LONG)
def q_write_report(spark, sf_dir):
    path = f"{shared_folder(spark)}/framewright/report-{uuid.uuid4().hex}"
    write_report(R.layer_long_report(line_cells(spark, sf_dir)), path)
    return spark.read.parquet(path)


@query(
    "table_cells_irregular",
    """WITH l AS (SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber::BIGINT AS l_linenumber,
        l_orderkey::BIGINT::VARCHAR AS a, l_partkey::BIGINT::VARCHAR AS b, l_suppkey::BIGINT::VARCHAR AS c,
        l_linenumber::BIGINT % 3 AS k FROM lineitem)
    SELECT l_orderkey, l_linenumber, 0::INT AS row_no, CASE k WHEN 0 THEN a || '|' || b
        WHEN 1 THEN a || b || c || '|' || b || c || '|' || c ELSE a || b || '|' || b || '|' || c END AS cells FROM l
    UNION ALL SELECT l_orderkey, l_linenumber, 1::INT, CASE k WHEN 2 THEN b ELSE c END FROM l""",
)
def q_table_cells_irregular(spark, sf_dir):
    """Of every three reports one is regular, one omits its end tags, one has a nested table."""
    keys = [F.col(c).cast("bigint").alias(c) for c in ("l_orderkey", "l_linenumber")]
    a, b, c = (F.col(f"l_{x}key").cast("bigint") for x in ("order", "part", "supp"))
    kind = F.col("l_linenumber").cast("bigint") % 3
    html = (
        F.when(kind == 0, F.format_string("<table><tr><td>%d</td><td>%d</td></tr><tr><td>%d</td></tr></table>", a, b, c))
        .when(kind == 1, F.format_string("<table><tr><td>%d<td>%d<tr><td>%d</table>", a, b, c))
        .otherwise(F.format_string("<tr><td>%d<table><tr><td>%d</td></tr></table></td><td>%d</td></tr>", a, b, c))
    )
    docs = spread_table(spark, sf_dir, "lineitem").select(*keys, html.alias("html"))
    rows = R.table_cells(docs, ["l_orderkey", "l_linenumber"])
    return rows.withColumn("cells", F.array_join("cells", "|"))
