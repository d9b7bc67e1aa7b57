import re
from html import unescape

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framewright.functions import cells as C
from framewright.functions import html as H
from framewright.operators import reports as R
from framewright.plans import layer_reports
from framewright.sources.reports import scan_html_reports, write_report

ROWS = [
    ("enc_layers_0_attentions_0.q", "", "", "0.99", "40.1", "0.001"),
    ("enc_layers_1_attentions_0.q", "", "", "0.98", "38.0"),
    ("enc_layers_0_attentions_0.q", "", "", "0.97", "35.0", "0.004"),
    ("enc_layers_7_attentions_0.k", "", "", "0.50", "10.0", "0.1"),
    ("head.out", "", "", "1.00", "60.0", "0.0"),
    ("a_layers_2_b_layers_3_attentions_0.v", "", "", "0.90", "30.0", "0.01"),
]


def table_html(rows=ROWS):
    body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    return f"<table><tr><th>Name</th><th>x</th></tr>{body}</table>"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("r1", table_html())], "path string, html string")


@pytest.fixture(scope="module")
def cells(docs):
    return R.table_cells(docs)


def test_header_row_has_no_cells(cells):
    rows = {r.row_no: r.cells for r in cells.collect()}
    assert rows[0] == [] and len(rows) == 7
    assert R.filter_nonempty_rows(cells).count() == 6


def test_separate_steps_equal_the_joint_one(docs, cells):
    apart = R.extract_row_cells(R.extract_table_rows(docs))
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, cells.collect()))


IRREGULAR = [
    ("omitted cell ends", "<table><tr><td>name<td>a &amp;lt; b</tr></table>"),
    ("omitted row end", table_html(ROWS[:2]).replace("</tr>", "", 2)),
    ("nested", "<tr><td>x<table><tr><td>in</td></tr></table></td><td>&nbsp;y</td></tr>"),
    ("many unclosed", "<tr>" + "<td>1" * 300),
    ("empty elements", "<tr/><tr><td/>x</td><td>y</td></tr>"),
    ("stray ends", "</td><tr></td><td>z</td></tr></tr>\n<!-- <tr> -->"),
    ("end with attribute", "<tr><td>q</td class='x'></tr>"),
    ("regular", table_html([("a &amp;lt; b", "3 < 4", "<b title='<tr>'>c</b>")])),
    ("no table", "text"),
    ("empty", ""),
    ("null", None),
]


def test_no_row_is_lost_without_end_tags_or_in_nested_tables(spark):
    docs = spark.createDataFrame(IRREGULAR, "path string, html string")
    expected = sorted(map(tuple, R.table_cells(docs, tolerant=True).collect()))
    assert sorted(map(tuple, R.table_cells(docs).collect())) == expected
    apart = R.extract_row_cells(R.extract_table_rows(docs))
    assert sorted(map(tuple, apart.collect())) == expected
    assert ("omitted cell ends", 0, ["namea &lt; b", "a &lt; b"]) in expected
    assert ("nested", 0, ["xin", "in", "y"]) in expected and ("nested", 1, ["in"]) in expected


def test_wide_report(docs):
    wide = {r[1]: r.asDict() for r in R.layer_wide_report(R.layer_rows(docs)).collect()}
    assert set(wide) == {
        "enc_layers__attentions_0.q", "enc_layers__attentions_0.k", "a_layers_2_b_layers__attentions_0.v",
    }
    q = wide["enc_layers__attentions_0.q"]
    assert [q[f"Layer 0 {p}"] for p in ("Cosine Similarity", "SQNR", "MSE")] == ["0.97", "35.0", "0.004"]
    assert [q[f"Layer 1 {p}"] for p in ("Cosine Similarity", "SQNR", "MSE")] == ["0.98", "38.0", None]
    assert q["Layer 2 Name"] is None
    k = wide["enc_layers__attentions_0.k"]
    assert all(k[c] is None for c in R.layer_columns())
    v = wide["a_layers_2_b_layers__attentions_0.v"]
    assert v["Layer 3 Name"] == "a_layers_2_b_layers_3_attentions_0.v" and v["Layer 2 Name"] is None


def test_overwrite_takes_nulls_too(spark):
    rows = [("e_layers_0_attentions_0", "", "", "1", "2", "3"), ("e_layers_0_attentions_0", "", "", "4")]
    docs = spark.createDataFrame([("a", table_html(rows))], "path string, html string")
    row = R.layer_wide_report(R.layer_rows(docs)).first()
    assert [row[f"Layer 0 {p}"] for p in R.METRIC_CELLS] == ["4", None, None]


def test_merged_report_takes_last_document(spark):
    rows = lambda v: [("e_layers_0_attentions_0", "", "", v, v, v)]
    docs = spark.createDataFrame(
        [("b", table_html(rows("2"))), ("a", table_html(rows("1")))], "path string, html string"
    )
    merged = R.layer_wide_report(R.layer_rows(docs), group=(), order=("path", "row_no")).collect()
    assert len(merged) == 1 and merged[0]["Layer 0 SQNR"] == "2"


def test_sparse_report(docs):
    rows = {r.row_no: r.asDict() for r in R.layer_sparse_report(R.layer_rows(docs)).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 6]
    assert rows[4]["Common Layer Name"] == "enc_layers__attentions_0.k"
    assert all(rows[4][c] is None for c in R.layer_columns())
    assert rows[2]["Layer 1 SQNR"] == "38.0" and rows[2]["Layer 0 SQNR"] is None


def test_long_report(cells):
    report = R.layer_long_report(cells).orderBy("Attention Layer", "row_no").collect()
    assert [(r.row_no, r["Attention Layer"]) for r in report] == [
        (1, "layer_0_attention_0"), (3, "layer_0_attention_0"),
        (2, "layer_1_attention_0"), (6, "layer_3_attention_0"),
    ]


def test_long_report_with_two_layers_in_one_name(spark):
    name = "layers_0_attentions_0.layers_2_attentions_0"
    docs = spark.createDataFrame([("a", table_html([(name, "", "", "1", "2", "3")]))], "path string, html string")
    tags = [r["Attention Layer"] for r in R.layer_long_report(R.table_cells(docs)).collect()]
    assert sorted(tags) == ["layer_0_attention_0", "layer_2_attention_0"]


def test_short_rows_fail_where_cells_are_required(cells):
    with pytest.raises(PySparkException, match="no cell 5"):
        R.layer_long_report(cells, on_short="error").collect()
    with pytest.raises(ValueError):
        R.metric_cells("ignore")


def test_prefix_report(cells):
    assert [r["Layer Name"] for r in R.layer_prefix_report(cells).collect()] == ["enc_", "enc_"]


def test_cell_text(spark):
    html = (
        "<table><tr class='a>b'><td>\n a\tb  </td><td><b>x</b> <i title=\"<td>\">y</i></td>"
        "<td>&amp;lt; &nbsp;</td><td>1 < 2</td><td><!-- <td>no</td> -->z</td></tr></table>"
    )
    docs = spark.createDataFrame([("a", html)], "path string, html string")
    assert R.table_cells(docs).first().cells == ["a\tb", "x y", "&lt;", "1 < 2", "z"]


def test_layer_pattern_dialect(spark):
    names = ["e_layers_٣_attentions_0.q", "a\re_layers_1_attentions_0.q", "a\ne_layers_1_attentions_0.q",
             "e_layers_1_attentions_0.q\nrest"]
    rows = spark.createDataFrame([(i, [n]) for i, n in enumerate(names)], "i int, cells array<string>")
    parsed = {r.i: r for r in R.parse_layer_name(R.filter_layer_rows(rows)).collect()}
    assert sorted(parsed) == [0, 1, 3]
    assert parsed[0].layer == "٣" and parsed[1].prefix == "a\re_layers_" and parsed[3].rest == ".q"


def test_tolerant_parser(spark):
    nested = "<table><tr><td>a<table><tr><td>b</td></tr></table></td><td>c &amp; d</td></tr><tr><td>e<td>f</tr></table>"
    docs = spark.createDataFrame([("n", nested), ("p", table_html())], "path string, html string")
    rows = R.table_cells(docs, tolerant=True)
    by_path = {p: [] for p in ("n", "p")}
    for r in sorted(rows.collect(), key=lambda r: r.row_no):
        by_path[r.path].append(r.cells)
    assert by_path["n"] == [["ab", "b", "c & d"], ["b"], ["ef", "f"]]
    plain = R.table_cells(docs.where("path = 'p'")).orderBy("row_no").collect()
    assert by_path["p"] == [r.cells for r in plain]


def test_strip_matches_python(spark):
    texts = ["".join(chr(c) for c in range(0x21)) + "x" + " \x85 　", "", " \n ", "a  b"]
    rows = spark.createDataFrame([(t.replace("\x00", ""),) for t in texts], "t string")
    got = [r[0] for r in rows.select(H.strip(F.col("t"))).collect()]
    assert got == [t.replace("\x00", "").strip() for t in texts]


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("one", "two"):
        (tmp_path / "in" / f"{name}.html").write_text(table_html())
    paths = str(tmp_path / "in")
    assert scan_html_reports(spark, paths).count() == 2
    wide = layer_reports.wide_report(spark, paths)
    assert wide.count() == 6
    out = str(tmp_path / "out")
    for fmt in ("parquet", "csv"):
        write_report(wide, f"{out}-{fmt}", fmt, index="Common Layer Name")
        back = spark.read.option("header", True).format(fmt).load(f"{out}-{fmt}")
        assert back.columns[0] == "Common Layer Name"
        assert sorted(map(str, back.select(sorted(wide.columns)).collect())) == sorted(
            map(str, wide.select(sorted(wide.columns)).collect())
        )
    with pytest.raises(ValueError):
        write_report(wide, out, "xlsx")
    with pytest.raises(PySparkException):
        layer_reports.long_report(spark, paths).collect()


def test_row_operators_run_on_a_stream(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
    query = (
        R.layer_long_report(R.table_cells(stream)).writeStream.format("memory")
        .queryName("long_report").option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        query.processAllAvailable()
        assert spark.table("long_report").count() == 4
    finally:
        query.stop()


def test_references_decoded_without_python_equal_the_parser(spark):
    """Common references by expressions, others by the tag stack: the same cells."""
    cells = ["&amp;lt; x", "a&nbsp;&nbsp;", "&nbsp;b &amp; c&nbsp;", "&lt;td&gt;", "&quot;q&quot; &#39;r&apos;", "&amp;amp;", "&amp;nbsp;", "R&D", "&eacute; &#233; &lt;", "& ", "x &ampy", "plain"]
    rows = [(k, f"<table><tr><td>{c}</td><td>{cells[k - 1]}</td></tr></table>") for k, c in enumerate(cells)]
    docs = spark.createDataFrame(rows, "path long, html string")
    got = sorted(map(tuple, R.table_cells(docs).collect()))
    assert got == sorted(map(tuple, R.table_cells(docs, tolerant=True).collect()))
    assert got == sorted((k, 0, [unescape(c).strip(), unescape(cells[k - 1]).strip()]) for k, c in enumerate(cells))


def test_names_parse_by_one_pattern_run(spark):
    names = ["a_layers_2_b_layers_3_attentions_0.v", "x_layers_1_attentions_0", "_layers_٣_attentions_0q", "n_layers_1_attentions_0.a\nrest", "n\n_layers_1_attentions_0", "", "no", "_layers_1_attentions_0\r.b"]
    rows = spark.createDataFrame([(k, [n]) for k, n in enumerate(names)] + [(90, [])], "id long, cells array<string>")
    got = {r["id"]: (r["prefix"], r["layer"], r["suffix"], r["rest"]) for r in R.parse_layer_name(rows).collect()}
    for k, name in enumerate(names):
        m = re.match(r"^(.*_layers_)(\d+)(_attentions_0)(.*)", name)
        assert got[k] == (m.groups() if m else ("", "", "", "")), name
    assert got[90] == (None, None, None, None)
    plan = R.parse_layer_name(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "regexp_extract" not in plan


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_reports_stream_through_python_without_a_queue(spark):
    """A column function's rows wait in a queue, on disk at last, while the next steps are slower than Python."""
    docs = spark.createDataFrame(IRREGULAR, "path string, html string")
    for rows in (R.table_cells(docs), R.table_cells(docs, unescape=False), R.extract_table_rows(docs), R.layer_rows(docs)):
        assert "ArrowEvalPython" not in _plan(rows) and _plan(rows).count("MapInArrow") == 1


def test_rows_of_both_kinds_of_documents_keep_their_keys_and_numbers(spark):
    odd, regular = "<tr><td>a<td>b<tr><td>c", "<tr><td>d</td></tr><tr></tr>"
    docs = spark.createDataFrame([(k, f"k{k}", [regular, odd, None, "", "no row"][k % 5]) for k in range(50)], "a int, b string, html string")
    want = []
    for k in range(50):
        want += [[(k, f"k{k}", 0, ["d"]), (k, f"k{k}", 1, [])], [(k, f"k{k}", 0, ["abc", "bc", "c"]), (k, f"k{k}", 1, ["c"])], [], [], []][k % 5]
    assert sorted(map(tuple, R.table_cells(docs.coalesce(1), ["a", "b"]).collect())) == want
    rows = R.extract_table_rows(docs.coalesce(1), ["a", "b"])
    assert sorted(map(tuple, R.extract_row_cells(rows).collect())) == want


def test_simple_markup_is_read_as_by_the_parser():
    bits = ['<tr>', '</tr>', '<td>', '</td>', '<TD>', '<td class="a b">', '<br>', '<b>', '</b>', 'x', '1 ', '\n', '<table>', '</table>']
    bits += ['</p>', '>', '<td/>', "<p a='1'>", '<!-- <td> -->', '&amp;', '<title>', '</td >', '</tr a="b">', '\0', '<']
    simple = 0
    for k in range(4000):
        text = "".join(bits[(k * 7919 + j * j * 31 + j * k) % (len(bits) if k % 3 == 0 else 16)] for j in range(k % 17))
        for row, cell in (("tr", "td"), ("table", "tr"), ("td", "td")):
            reader = R._CellReader(row, cell)
            reader.read(text)
            found = R._simple_cells(text, row, cell)
            assert found is None or found == reader.cells(), text
            simple += found is not None
    assert simple > 6000 and R._simple_cells("<tr><td>a<script><td></script>", "tr", "td") is None


def _wide_by_pivot(rows, group, order):
    latest = F.max_by(F.struct("Name", *R.METRIC_CELLS), F.struct(*order))
    wide = rows.groupBy(*group, R.COMMON_NAME).pivot("layer", [str(i) for i in R.LAYERS]).agg(latest)
    parts = [F.col(f"`{i}`")[p].alias(f"Layer {i} {p}") for i in R.LAYERS for p in ("Name", *R.METRIC_CELLS)]
    return sorted(map(repr, wide.select(*group, R.COMMON_NAME, *parts).collect()))


def test_wide_report_of_odd_values_is_what_a_pivot_gives(spark):
    odd = ["7", None, "", "\0", "\x01", "\x01n", "\x01p3", "a\0\x01a\0b", "x\x01\0"]
    names = [
        ("e_layers_{}_attentions_0.k", "e_layers__attentions_0.k"),
        ("e_layers_{}_attentions_0_layers_{}_attentions_0", "e_layers_{}_attentions_0_layers__attentions_0"),
        ("layers_{}_attentions_0", "layers__attentions_0"), ("other", "e"), (None, "e"), ("\x01p3", "e"), ("né_layers_{}_attentions_0", None),
    ]
    rows = []
    for k in range(900):
        (name, common), layer = names[k % 7], str(k * 13 % 41 % 7)
        cells = [odd[(k + j * (k % 5)) % 9] for j in range(3)]
        rows.append((f"p{k % 4}" if k % 11 else None, k, layer if k % 17 else None, common and common.replace("{}", layer), name and name.replace("{}", layer), *cells))
    kind = "path string, row_no int, layer string, `Common Layer Name` string, Name string, `Cosine Similarity` string, SQNR string, MSE string"
    rows = spark.createDataFrame(rows, kind).repartition(3)
    number = F.col("row_no")
    for order in (number, F.when(number == 899, float("nan")).otherwise(number / 7), F.array("row_no"), F.when(number > 0, -number)):
        own = rows.withColumn("row_no", order)
        for group, by in ((["path"], ["row_no"]), ([], ["path", "row_no"])):
            got = sorted(map(repr, R.layer_wide_report(own, group, by).collect()))
            assert got == _wide_by_pivot(own, group, by)
    numbers = rows.withColumn("MSE", F.col("row_no") / 2)
    assert sorted(map(repr, R.layer_wide_report(numbers).collect())) == _wide_by_pivot(numbers, ["path"], ["row_no"])


def test_rows_of_a_wide_report_are_put_together_before_they_are_sorted(spark):
    rows = spark.range(3000).selectExpr(
        "'p' path", "cast(id as int) row_no", "cast(id % 3 as string) layer", "'c' `Common Layer Name`",
        "'n' Name", "'a' `Cosine Similarity`", "'b' SQNR", "'c' MSE").coalesce(1)
    plan = _plan(R.layer_wide_report(rows))
    assert plan.count("MapInArrow") == 1 and plan.rindex("SortAggregate") < plan.index("MapInArrow")
    marked = rows.selectExpr("path", "cast(layer as int) + 1 _layer", "struct(struct(row_no) `order`, Name `values`) _row")
    put = R._rows_put_together(marked, ["a", "b", "c"]).collect()
    assert len(put) == 1 and [put[0][c]["order"]["row_no"] for c in "abc"] == [2997, 2998, 2999]


def test_cells_that_every_layer_reads_are_stored_packed(spark, tmp_path, monkeypatch):
    from framewright import session
    from workload.reports import q_union_layers

    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    q_union_layers(spark, "/root/testdata/sf0.001")
    stored = list(tmp_path.glob("framewright/cells-*/*.parquet"))
    assert stored and all(f.name.endswith(".zstd.parquet") for f in stored)


BITS = ["<tr>", "</tr>", "<td>", "</td>", "<TD a='x\"'>", '<td title="a>b">', "<b>", "</b>", "x", " 1 ", "\n", "&nbsp;", "&amp;", "&lt;", "3 < 4", "it's", "é",
        "　", '"', ">", "<!-- <td> -->", '<a title="8 > 4">', "&eacute;", "&", "<", "<br/>", "<td/>", "</td >", "</tr x>", "<!-->", "<!--", "-->", '<a title="<td>">',
        "<a b='<!-- x'>", "<script>if(a<b)'</td>'</script>", "<STYLE x>", "</style >", "<styled>", "\0", "<tré>", "<td:x>", "<table>", "</table>", "<?x?>", "</>", "<td", "<tr"]


def _mixed_markup(k: int) -> str:
    if k % 3 == 0:
        return "".join(BITS[(k * 7919 + j * j * 31 + j * k) % len(BITS)] for j in range(k % 17))
    bits = BITS[6:22] if k % 3 == 1 else BITS[6:]
    cell = lambda j: "".join(bits[(k * 31 + j * 17 + i * (k % 13 + 1)) % len(bits)] for i in range((k + j) % 4))
    row = lambda j: ["<tr>", "<TR class='x'>"][j % 2] + "".join(f"<td{' a=1' * (c % 2)}>{cell(j + c)}</td>" for c in range((k + j) % 4)) + "</tr>"
    return "<table>" + "\n".join(row(j) for j in range(k % 5))


def test_cells_cut_from_many_documents_are_those_of_each_document(monkeypatch):
    texts = [None if k % 97 == 0 else _mixed_markup(k) for k in range(1500)]
    column = pa.chunked_array([pa.array(["<tr><td>before</td></tr>", *texts])]).chunk(0).slice(1)
    single = C.regular_cells
    alone = []
    monkeypatch.setattr(C, "regular_cells", lambda text, *tags: alone.append(text) or single(text, *tags))
    for stretch in (1 << 20, 500):
        monkeypatch.setattr(C, "_STRETCH", stretch)
        for row_tag, cell_tag in (("tr", "td"), ("table", "tr"), ("TD", "b")):
            for unescape in (True, False):
                alone.clear()
                found = {}
                for at, row_no, cells in C.cells_of_documents(column, row_tag, cell_tag, unescape, lambda t: R._nested_cells(t, row_tag, cell_tag)):
                    for k, n, row in zip(at.to_pylist(), row_no.to_pylist(), cells.to_pylist()):
                        found.setdefault(k, []).append(row)
                        assert n == len(found[k]) - 1
                assert row_tag != "tr" or 0 < len(alone) < 1000
                for k, text in enumerate(texts):
                    rows = single(text or "", row_tag, cell_tag, unescape)
                    assert found.get(k, []) == (R._nested_cells(text, row_tag, cell_tag) if rows is None else rows), text


def test_reports_with_comments_quotes_and_references_are_not_read_one_by_one(spark, monkeypatch):
    html = "<html><!-- <tr><td>no</td></tr> --><table class='q'><tr><th>n</th></tr><tr><td>\n <b>x</b>&nbsp;</td><td><a title=\"8 > 4\">a &amp; b</a></td></tr></table>"
    monkeypatch.setattr(C, "regular_cells", None)
    found = [*C.cells_of_documents(pa.array([html, None, html]), "tr", "td", True, None)]
    assert [(a.to_pylist(), n.to_pylist(), c.to_pylist()) for a, n, c in found] == [([0, 0, 2, 2], [0, 1, 0, 1], [[], ["x", "a & b"]] * 2)]
    plan = _plan(R.table_cells(spark.createDataFrame([("a", html)], "path string, html string")))
    assert "regexp" not in plan and "Generate" not in plan and plan.count("MapInArrow") == 1


def test_documents_that_are_not_text_are_read_with_replaced_characters():
    raw = pa.array([b"<tr><td>a</td></tr>", b"<tr><td>\xff b</td></tr>"], pa.binary())
    docs = pa.Array.from_buffers(pa.string(), 2, raw.buffers())
    found = [row for _, _, cells in C.cells_of_documents(docs, "tr", "td", True, None) for row in cells.to_pylist()]
    assert found == [["a"], ["� b"]]


def test_ordered_columns_query_keeps_the_columns_of_every_layer(spark):
    from workload.reports import q_ordered_columns

    report = q_ordered_columns(spark, "/root/testdata/sf0.001")
    assert report.columns == [R.COMMON_NAME, *R.layer_columns()] and len(report.columns) == 21
    filled = report.agg(*[F.count(f"`Layer {i} MSE`") for i in R.LAYERS]).first()
    assert all(filled)


def test_ordered_columns_fills_up_and_drops(spark):
    report = spark.createDataFrame([("c", "n", "z")], f"`{R.COMMON_NAME}` string, `Layer 1 Name` string, other string")
    row = R.ordered_columns(report, layers=(0, 1)).first().asDict()
    assert [*row] == [R.COMMON_NAME, *R.layer_columns((0, 1))] and row["Layer 1 Name"] == "n" and row["Layer 0 SQNR"] is None


def test_packed_values_of_a_wide_report_are_split_once_a_layer(spark):
    docs = spark.createDataFrame([("r1", table_html())], "path string, html string")
    for group, order in ((["path"], ["row_no"]), ([], ["path", "row_no"])):
        plan = R.layer_wide_report(R.layer_rows(docs), group, order)._jdf.queryExecution().optimizedPlan().toString()
        wide = plan[: plan.index("MapInArrow")]
        assert wide.count("split(") == len(R.LAYERS)


def test_rows_are_put_together_by_the_last_of_any_order(spark):
    import datetime
    from decimal import Decimal

    orders = {
        "double": [1.5, None, float("nan"), -2.0, 9.0], "string": ["b", None, "é", "a", ""], "boolean": [True, None, False, False, True],
        "date": [datetime.date(2020, 1, k + 1) if k else None for k in range(5)], "decimal(9,2)": [Decimal(k) / 4 - 1 for k in range(5)], "binary": [b"a", None, b"\xff", b"", b"b"],
    }
    for kind, values in orders.items():
        rows = [(f"g{k % 3}" if k % 7 else None, k % 3 + 1 if k % 4 else None, (((k * 11) % 5, values[k * 3 % 5]), f"v{k}")) for k in range(60)]
        df = spark.createDataFrame(rows, f"g string, _layer int, _row struct<`order`:struct<a:int,b:{kind}>,v:string>").coalesce(1)
        put = {r.g: [r[c] and r[c].v for c in "abc"] for r in R._rows_put_together(df, ["a", "b", "c"]).collect()}
        rank = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)
        want = {}
        for g, layer, ((a, b), v) in rows:
            held = want.setdefault(g, [None] * 3)
            if layer and (held[layer - 1] is None or held[layer - 1][0] <= (a, rank(b))):
                held[layer - 1] = ((a, rank(b)), v)
        assert put == {g: [h and h[1] for h in held] for g, held in want.items()}


def test_long_report_asks_every_name_without_a_lambda(cells):
    assert "lambda" not in _plan(R.layer_long_report(cells)) and "lambda" not in _plan(R.layer_long_report(cells, layers=[1]))
