"""Column functions and kernels against literal expectations."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from tessera.functions import html, lines, scores, text, times
from tessera.operators import feeds, merge, metrics


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "wanted"),
    [
        ("https://Example.com/story?utm_source=test", "https://example.com/story"),
        ("HTTP://user:pw@A.org:80//x//y/?b=2&a=1&ref=z#frag", "http://a.org/x/y?a=1&b=2"),
        ("https://a.org", "https://a.org/"),
        ("https://a.org:8443/p/?q", "https://a.org:8443/p?q="),
    ],
)
def test_canonical_url(spark, url, wanted):
    assert one(spark, text.canonical_url(F.lit(url))) == wanted


def test_identifiers(spark):
    assert one(spark, text.doi(F.lit("doi:10.1038/d41586-026-00814-3The rest"))) == "10.1038/d41586-026-00814-3"
    assert one(spark, text.arxiv_id(F.lit("see 2401.01234v2 there"))) == "2401.01234v2"
    assert one(spark, text.arxiv_id(F.lit("none"))) is None
    assert [one(spark, text.identifier_kind(F.lit(q))) for q in ("10.1000/xyz", "arXiv:2401.01234", "12345678", "word")] == ["doi", "arxiv", "pmid", None]


def test_tokens_and_jaccard(spark):
    assert one(spark, text.title_tokens(F.lit("A new AI-model study of the Weather"))) == ["ai", "model", "weather"]
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    assert one(spark, scores.jaccard(a, b)) == pytest.approx(1 / 3)


@pytest.mark.parametrize(("a", "b", "wanted"), [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], None)])
def test_cosine(spark, a, b, wanted):
    assert one(spark, scores.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))) == wanted


def test_gates(spark):
    gate = lambda s, c=0.8, e=0.5, t=0.98, n=0: one(spark, scores.passes_gates(F.lit(s), F.lit(c), F.lit(e), F.lit(t), F.lit(n)))
    assert gate(0.99)
    assert not gate(0.96)
    assert gate(0.972, t=0.98)  # the escape hatch
    assert gate(0.97, t=0.999, n=2) and not gate(0.97, t=0.999, n=1)
    assert not gate(0.99, c=0.7) and not gate(0.99, e=0.3)
    assert not gate(None)


def test_quiet_hours(spark):
    at = lambda h: F.lit(datetime(2024, 1, 10, h)).cast("timestamp")
    plan = lambda h: one(spark, times.schedule(at(h), F.lit("UTC"), F.lit(22 * 60), F.lit(8 * 60)))
    assert plan(12) == datetime(2024, 1, 10, 12)
    assert plan(23) == datetime(2024, 1, 11, 8)
    assert plan(3) == datetime(2024, 1, 10, 8)


def test_html():
    page = '<html><head><base href="https://a.org/x/"><meta property="og:image" content="pic.png"><script>no</script></head><body><nav>no</nav><p>One &amp; two</p><p>three</p><footer>no</footer></body></html>'
    assert html.page_text(page) == "One & two\n\nthree"
    assert html.page_image(page, "https://b.org/") == "https://a.org/x/pic.png"
    assert html.page_image('<article><img src="data:x"><img src="/y.png"></article>', "https://b.org/q") == "https://b.org/y.png"
    assert html.page_text(None) == "" and html.page_image("", None) is None


def test_lines():
    assert lines.join_section_numbers(["1", "", "Introduction", "text"]) == ["1 Introduction", "text"]
    assert lines.join_leading_marks(["as shown", ", and so"]) == ["as shown, and so"]
    assert lines.stitch_citations(["as in", "(", "Smith, 2020", ")", "next"]) == ["as in", "(Smith, 2020)", "next"]
    assert lines.drop_adjacent_repeats(["A sentence that says it.", "", "a sentence that says it"]) == ["A sentence that says it.", ""]
    assert lines.drop_early_repeats(["Journal of X", "text", "Journal of X"]) == ["Journal of X", "text"]
    assert lines.clean_lines(None) == "" and lines.clean_lines("ﬁne\x00\n\n\n\nend") == "fine\n\nend"
    assert lines.same_table("| a | b |", "a b c") and not lines.same_table("a b", "c d")


def test_gate_truth_table(spark):
    ok = lambda s: one(spark, text.fulltext_ok(F.lit(s)))
    assert not ok("too short.")
    assert not ok("word " * 450 + "method results")
    assert ok("introduction method results discussion references " + "longword " * 650)


def test_merge_twice_is_once(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id long, title string, ident string")
    s = spark.createDataFrame([(2, "B", "y"), (3, "c", None)], "id long, title string, ident string")
    once = merge.merge(t, s, ["id"], {"ident": "keep_first"})
    twice = merge.merge(once, s, ["id"], {"ident": "keep_first"})
    rows = sorted(map(tuple, once.collect()))
    assert rows == [(1, "a", None), (2, "B", "x"), (3, "c", None)] == sorted(map(tuple, twice.collect()))
    assert sorted(map(tuple, merge.patch(t, F.col("id") == 2, {"title": None}, {"title": ["ident"]}).collect())) == [(1, "a", None), (2, None, None)]


def test_explainers(spark):
    got = lambda s: {k: one(spark, c) for k, c in feeds.explainers(F.lit(s)).items()}
    assert got('{"markdown": "m", "eli20": "a"}') == {"markdown": "m", "eli20": "a", "eli5": None}
    assert got(" plain ") == {"markdown": "plain", "eli20": None, "eli5": None}


def test_in_focus_has_at_least_one(spark):
    c = spark.createDataFrame([(k, "active", float(k), datetime(2024, 1, 1)) for k in range(5)], "id long, status string, impact_score double, updated_at timestamp")
    assert [r.id for r in metrics.in_focus(c).where("in_focus_label").collect()] == [4]


def test_source_archives(spark):
    import gzip
    import io
    import tarfile

    from pyspark.sql import functions as F
    from tessera.functions import payloads

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as archive:
        for name, body in (("short.tex", b"x"), ("main.tex", b"\\section{Introduction}"), ("fig.png", b"0" * 99)):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            archive.addfile(info, io.BytesIO(body))
    rows = [(1, out.getvalue()), (2, gzip.compress(b"alone")), (3, b"no archive"), (4, None)]
    found = {r.k: r.t for r in spark.createDataFrame(rows, "k int, c binary").select("k", payloads.archived_tex(F.col("c")).alias("t")).collect()}
    assert found == {1: "\\section{Introduction}", 2: "alone", 3: None, 4: None}


def test_tagging_upkeep(spark):
    from pyspark.sql import functions as F
    from tessera.operators import tagging

    clusters = spark.createDataFrame([(1, "Lasers", "active"), (2, "untitled", "active"), (3, "Tagged", "active")], "id long, canonical_title string, status string").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    items = spark.createDataFrame([("a", "a long title about lasers and light")], "id string, title string").withColumn("published_at", F.lit("2024-01-01").cast("timestamp")).withColumn("fetched_at", F.col("published_at"))
    members = spark.createDataFrame([(1, "a", 1)], "cluster_id long, item_id string, source_id long")
    docs = spark.createDataFrame([(3, "long enough to stay as it is, surely")], "cluster_id long, search_text string").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    topics = spark.createDataFrame([(3, 9, 1.0, "editor", True)], "cluster_id long, topic_id long, score double, source string, locked boolean")
    out = tagging.maintained(clusters, members, items, docs, topics, spark.createDataFrame([(7, "lasers")], "id long, alias string"), F.lit("2024-02-01").cast("timestamp"), least=20)
    assert {(r.cluster_id, r.topic_id) for r in out["cluster_topics"].collect()} == {(3, 9), (1, 7)}
    assert {r.id: r.status for r in out["clusters"].collect()} == {1: "active", 2: "quarantined", 3: "active"}
    assert {r.cluster_id: r.reason for r in out["reasons"].collect()} == {2: "placeholder_title"}
    assert {r.cluster_id for r in out["docs"].collect()} == {1, 3}
