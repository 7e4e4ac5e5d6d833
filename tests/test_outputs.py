import json
import random
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plain_scoring import ranked_keywords
from termloom.operators import prompts
from termloom.operators.keywords import analyze_pages
from termloom.operators.topics import DEFAULT_TAXONOMY, Taxonomy, page_topics, topic_names
from termloom.params import Params
from termloom.plans.analysis import analyze_url_list, run_analysis
from termloom.sinks import reports
from termloom.storage import working_tables
from test_across_pages import TAXONOMY, frame, page
from termloom.vocab import GAP_SECTIONS


def lines(path):
    return [
        json.loads(line)
        for part in sorted(path.glob("part-*"))
        for line in part.read_text(encoding="utf-8").splitlines()
    ]


PAGES = [
    page(3, [("visa fee", 9), ("other", 8), ("tax", 7)]),
    page(5, [], "HTTP 403 for u"),
    page(8, []),
    page(9, [(f"w{i:02d}", 99 - i) for i in range(40)]),
]


def test_prompt_blocks(spark):
    rows = prompts.page_blocks(frame(spark, PAGES), TAXONOMY).orderBy("page_no").collect()
    assert [(r.ord, r.page_no) for r in rows] == [(3, 1), (8, 2), (9, 3)]
    assert rows[0].block == (
        "URL 1: http://p/3\nTop Keywords: visa fee, other, tax\nTopics: Money, General"
    )
    assert rows[1].block == "URL 2: http://p/8\nTop Keywords: \nTopics: "
    assert rows[2].block.split("\n")[1] == "Top Keywords: " + ", ".join(f"w{i:02d}" for i in range(30))


def test_blocks_name_topics_without_listing_their_keywords(spark):
    names = ["visa fee", "tax", None, "other", "Visa", "work permit"]
    rows = [(1, names), (2, names[::-1]), (3, ["other"]), (4, []), (5, None)]
    found = spark.createDataFrame(rows, "ord int, names array<string>").select(
        F.transform("names", lambda n: F.struct(n.alias("keyword"))).alias("k")
    )
    for taxonomy in (TAXONOMY, DEFAULT_TAXONOMY, Taxonomy.of({"B": ["visa"], "A": [], "B2": ["fee", "tax"]}, match="word")):
        listed = F.transform(page_topics(F.col("k"), taxonomy), lambda t: t["topic"])
        for r in found.select(listed.alias("a"), topic_names(F.col("k"), taxonomy).alias("b")).collect():
            assert r.a == r.b
    plan = prompts.page_blocks(frame(spark, PAGES), TAXONOMY)._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan


def test_prompts_hold_every_page_once(spark):
    blocks = prompts.page_blocks(frame(spark, PAGES), TAXONOMY)
    whole = prompts.gap_prompts(blocks, template="<{domain}>{pages}</{sections}>", domain="tea").collect()
    assert len(whole) == 1 and whole[0].n_pages == 3
    assert whole[0].prompt.startswith("<tea>URL 1: ") and "\n\nURL 2: " in whole[0].prompt
    assert all(name in whole[0].prompt for name in GAP_SECTIONS)
    split = prompts.gap_prompts(blocks, params=Params(pages_per_prompt=2)).orderBy("prompt_no").collect()
    assert [(r.prompt_no, r.n_pages) for r in split] == [(1, 2), (2, 1)]
    assert "URL 3: " in split[1].prompt and "URL 2: " not in split[1].prompt
    with pytest.raises(ValueError):
        prompts.gap_prompts(blocks, template="no place for them")


def test_parse_responses(spark):
    full = json.dumps({name: [name[:3], "ü"] for name in GAP_SECTIONS})
    rows = [
        ("plain", full, None), ("fenced", f"```json\n{full}\n```", None), ("upper", f"```JSON {full} ```  ", None),
        ("bare", f"```\n{full}```", None), ("partial", '{"semantic_keywords": ["x"]}', None),
        ("bad", "{not json", None), ("array", "[1]", None), ("null", None, None), ("empty", "", None),
        ("quota1", None, "got 429 back"), ("quota2", None, "Quota exceeded"), ("quota3", full, "over quota"),
        ("failed", None, "socket closed"), ("QUOTA", None, "QUOTA"), ("blank", full, ""),
    ]
    df = spark.createDataFrame(rows, "group_id string, response_text string, error_message string")
    parsed = prompts.parse_gap_responses(df)
    got = {r.group_id: r for r in parsed.collect()}
    for name in ("plain", "fenced", "upper", "bare", "blank"):
        assert got[name].error is None and got[name].semantic_keywords == ["sem", "ü"], name
    assert got["partial"].error is None and got["partial"].commonly_used_keywords == []
    assert got["partial"].semantic_keywords == ["x"]
    errors = {k: r.error for k, r in got.items() if r.error}
    assert errors == {
        "bad": "error", "array": "error", "null": "error", "empty": "error", "failed": "error",
        "QUOTA": "error", "quota1": "quota", "quota2": "quota", "quota3": "quota",
    }
    assert all(got[k][s] == [] for k in errors for s in GAP_SECTIONS)
    items = prompts.response_items(parsed.where("group_id = 'plain'")).collect()
    assert {(r.section, r.rank, r.item) for r in items} == {
        (s, i, w) for s in GAP_SECTIONS for i, w in ((1, s[:3]), (2, "ü"))
    }


HTML = [
    (0, "http://a", "<main>" + "visa fee permit. " * 30 + "</main>"),
    (1, "http://b", "<article>" + "visa fee student visa. " * 30 + "</article>"),
    (2, "http://c", "<p>too short</p>"),
    (3, "http://d", "<body>" + "student visa housing " * 20 + "</body>"),
    (4, "http://e", None),
]


def test_run_and_written_reports(spark, tmp_path):
    df = spark.createDataFrame(HTML, "ord bigint, url string, html string")
    tables = run_analysis(df)
    stats = tables["run_stats"].first()
    assert (stats.total_urls, stats.processed_urls, stats.failed_urls, stats.threshold) == (5, 3, 2, 2)
    common = [r.keyword for r in tables["common_keywords"].orderBy("rank").collect()]
    assert "visa fee" in common and "student visa" in common and "visa" not in common
    assert {r.error for r in tables["page_status"].collect()} == {None, "Insufficient content extracted"}

    out = tmp_path / "out"
    top = out
    for _ in range(2):  # writing again replaces
        reports.write_reports(tables, str(top))
    out = Path(reports.report_folder(spark, str(top)))
    assert [f.name for f in (top / "runs").iterdir()] == [out.name]
    per_url = lines(out / "url_analysis")
    assert [r["url"] for r in per_url] == ["http://a", "http://b", "http://d"]
    assert list(per_url[0]) == ["url", "keyword_frequency_map", "topic_clusters"]
    first = per_url[0]["keyword_frequency_map"]
    assert list(first.values()) == sorted(first.values(), reverse=True) and first["visa fee permit"] == 270
    assert sum(len(v) for v in per_url[0]["topic_clusters"].values()) == len(first)
    assert lines(out / "common_keywords") == [{"common_keywords": common}]
    clusters = lines(out / "topic_clusters")
    assert [(r["topic_rank"], r["rank"]) for r in clusters] == sorted((r["topic_rank"], r["rank"]) for r in clusters)
    gap = lines(out / "gap_analysis")
    assert list(gap[0]) == list(GAP_SECTIONS) and set(gap[0]["commonly_used_keywords"]) == set(common)
    lacking = [r.keyword for r in tables["common_keywords"].collect() if r.df < 3]
    assert set(gap[0]["ranking_recommendations"]) == set(lacking) and lacking
    advice = lines(out / "ranking_recommendations")
    assert {(r["url"], r["item"]) for r in advice} >= {("http://a", "student visa"), ("http://d", "visa fee")}
    totals = spark.read.parquet(str(out / "keyword_totals"))
    assert totals.count() == tables["keyword_totals"].count()
    assert tables["prompts"].first().n_pages == 3


def test_a_failed_run_leaves_the_old_reports(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(HTML, "ord bigint, url string, html string")
    out = str(tmp_path / "out")
    assert reports.report_folder(spark, out) is None
    tables = run_analysis(df)
    first = reports.write_reports(tables, out)
    held = {f: f.read_bytes() for f in Path(first).rglob("*.json")}

    def fails(*_):
        raise RuntimeError("lost")

    other = run_analysis(df.where("ord < 2"))
    for name in ("write_common_keywords", "write_gap", "_commit"):
        with monkeypatch.context() as patch:
            patch.setattr(reports, name, fails)
            with pytest.raises(RuntimeError):
                reports.write_reports(other, out)
        assert reports.report_folder(spark, out) == first
        assert {f: f.read_bytes() for f in Path(first).rglob("*.json")} == held
        assert len(list((tmp_path / "out" / "runs").iterdir())) == 1
    second = reports.write_reports(other, out)
    assert reports.report_folder(spark, out) == second != first and not Path(first).exists()
    assert len(lines(Path(second) / "url_analysis")) == 2
    assert sorted(f.name for f in (tmp_path / "out").iterdir() if not f.name.endswith(".crc")) == ["current.json", "runs"]


def test_prompts_are_bounded_by_size(spark):
    draw = random.Random(3)
    rows = []
    for group, count in (("a", 300), (None, 40), ("b", 1), ("long", 6)):
        for n in range(1, count + 1):
            size = 5000 if group == "long" and n % 2 else draw.choice([3, 40, 90, 300, 700])
            rows.append((group, n, n, "x" * size))
    blocks = spark.createDataFrame(rows, "g string, ord bigint, page_no bigint, block string").repartition(5)
    for most, pages_each in ((1500, 1000), (1500, 3), (100, 1000), (10**6, 1000), (1, 1000)):
        params = Params(prompt_chars=most, pages_per_prompt=pages_each)
        found = prompts.gap_prompts(blocks, ["g"], template="<{pages}>", params=params).collect()
        for group in ("a", None, "b", "long"):
            own = sorted((r for r in found if r.g == group), key=lambda r: r.prompt_no)
            assert [r.prompt_no for r in own] == list(range(1, len(own) + 1))
            texts = [r.prompt[1:-1] for r in own]
            assert "\n\n".join(texts) == "\n\n".join(b for g, _, _, b in rows if g == group)
            for r, text in zip(own, texts):
                assert r.n_pages == text.count("\n\n") + 1 <= pages_each
                assert len(text) <= most or r.n_pages == 1
            if most == 1500 and pages_each == 1000 and group == "a":
                assert len(own) < 2 * sum(map(len, texts)) / most  # not many half-empty ones
    one = prompts.gap_prompts(blocks.where("g = 'a'").drop("g"), (), template="<{pages}>", params=Params(prompt_chars=1500))
    assert one.agg(F.sum("n_pages")).first()[0] == 300 and one.agg(F.max(F.length("prompt"))).first()[0] <= 1502
    assert prompts.gap_prompts(blocks.limit(0), ["g"], params=Params(prompt_chars=9)).count() == 0


def test_grouped_run_equals_separate_runs(spark):
    rows = [(i, f"http://{i}", t, "q1" if i % 2 else "q2") for i, t in enumerate(
        ["visa fee permit. " * 30, "visa fee student visa. " * 30, "student visa housing. " * 20,
         "visa rent. " * 40, "fee rent visa. " * 30])]
    df = spark.createDataFrame(rows, "ord bigint, url string, text string, query string")
    both = run_analysis(df, group_cols=["query"])
    for q in ("q1", "q2"):
        alone = run_analysis(df.where(f"query = '{q}'"))
        for name in ("common_keywords", "merged_topics", "keyword_totals", "prompts", "run_stats", "gap"):
            mine = both[name].where(f"query = '{q}'").drop("query").select(*alone[name].columns)
            assert sorted(map(str, mine.collect())) == sorted(map(str, alone[name].collect())), name


def test_null_urls_do_not_mix_sections(spark):
    rows = [(i, None, t) for i, t in enumerate(["visa fee permit. " * 30, "visa fee. " * 40, "housing rent. " * 30])]
    gap = run_analysis(spark.createDataFrame(rows, "ord bigint, url string, text string"))["gap"]
    report = reports.gap_report(gap).first()
    assert len(report.ranking_recommendations) <= 15
    per_page = gap.where(F.col("section") == "page_recommendations").collect()
    assert per_page and {r.ord for r in per_page} == {2}


@pytest.mark.parametrize("text", ["\n```json\n{}\n```", "\u00a0\t```JSON {}```\n", "```\n{}\n```  ", "{}", " \n{} "])
def test_fences_and_white_space(spark, text):
    body = '{"semantic_keywords": ["a b"]}'
    df = spark.createDataFrame([(1, text.replace("{}", body), None)], "group_id int, response_text string, error_message string")
    row = prompts.parse_gap_responses(df).first()
    assert row.error is None and row.semantic_keywords == ["a b"]


def test_no_pages_is_an_error(spark):
    with pytest.raises(ValueError):
        run_analysis(spark.createDataFrame([], "ord bigint, url string, text string"))


def test_empty_common_report(spark):
    from termloom.operators import aggregate

    found = frame(spark, [page(1, [("a b", 9)])])
    report = reports.common_report(aggregate.keyword_totals(found), aggregate.page_stats(found))
    assert [r.common_keywords for r in report.collect()] == [[]]


def test_custom_inputs(spark):
    df = spark.createDataFrame([(0, "u", "alpha beta gamma " * 20)], "ord bigint, url string, text string")
    params = replace(Params(), max_keywords=2)
    row = analyze_pages(df, stop_words=["beta"], params=params).first()
    assert [k.keyword for k in row.keywords] == ["alpha", "gamma"]
    assert Taxonomy.of({"T": ["alp"]}).names == ["T", "General"]


def test_url_list_names_a_page_often(spark):
    listed = spark.createDataFrame(
        [(i, "http://a" if i % 3 else "http://b") for i in range(12)] + [(12, "http://none"), (13, "http://c")],
        "ord bigint, url string",
    )
    crawled = spark.createDataFrame(HTML, "page_id bigint, url string, html string").drop("page_id")
    for in_row in (None, -1, 10**6):
        found = analyze_url_list(listed, crawled, Params(in_row_max_chars=in_row))
        rows = {r.ord: r for r in found.collect()}
        assert len(rows) == 14 and found.count() == 14
        assert {len(rows[i].keywords) for i in range(12)} == {len(rows[0].keywords), len(rows[1].keywords)}
        best = ranked_keywords("visa fee permit. " * 30)
        assert [k.keyword for k in rows[1].keywords] == [b[0] for b in best] and rows[1].error is None
        assert rows[12].error == "No response received for http://none" and rows[12].keywords == []
        assert rows[13].error == "Insufficient content extracted"
    stats = run_analysis(found)["run_stats"].first()
    assert (stats.total_urls, stats.processed_urls, stats.failed_urls, stats.threshold) == (14, 12, 2, 6)


def test_working_tables_are_removed(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a", "visa fee permit. " * 30)], "ord bigint, url string, text string")
    with working_tables(spark, str(tmp_path)) as folder:
        tables = run_analysis(df)
        assert tables["keyword_totals"].count() > 0 and any(tmp_path.iterdir())
        assert folder.startswith(str(tmp_path))
    assert not any(tmp_path.iterdir())
