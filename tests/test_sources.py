import pytest
from pyspark.sql import functions as F

from termloom.functions import charset
from termloom.functions.membership import keep_possible_members
from termloom.params import Params
from termloom.plans.analysis import analyze_url_list
from termloom.sources import crawl, pages, urls


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def listed(df):
    return [(r.ord, r.url) for r in df.orderBy("ord").collect()]


def test_both_header_spellings(spark, tmp_path):
    path = write(tmp_path / "u.csv", "\n".join([
        "Rank,URL,url",
        "1,  http://a/x  ,http://z",
        "2,,http://b",
        "",
        '3,"http://c/?q=1,2",',
        '4,"http://d/\nline",',
        "5,ftp://e,http://e",
        "6,http://a/x,",
        "7,,",
        "8,HTTP://f,",
        "9,httpx://g,",
    ]))
    before = spark.conf.get("spark.sql.caseSensitive")
    assert listed(urls.read_urls(spark, path)) == [
        (0, "http://a/x"), (1, "http://b"), (2, "http://c/?q=1,2"), (3, "http://d/\nline"),
        (4, "http://a/x"), (5, "httpx://g"),
    ]
    assert spark.conf.get("spark.sql.caseSensitive") == before


@pytest.mark.parametrize("header", ["URL", "url"])
@pytest.mark.parametrize("multi_line", [True, False])
def test_one_header_spelling(spark, tmp_path, header, multi_line):
    path = write(tmp_path / "u.csv", f"n,{header}\n" + "".join(f"{i},http://u/{i}\n" for i in range(50)))
    got = listed(urls.read_urls(spark, path, multi_line=multi_line))
    assert got == [(i, f"http://u/{i}") for i in range(50)]


def test_other_spellings_are_not_urls(spark, tmp_path):
    path = write(tmp_path / "u.csv", "Url,n\nhttp://a,1\n")
    with pytest.raises(ValueError):
        urls.read_urls(spark, path)
    assert listed(urls.read_urls(spark, path, require=False)) == []


def test_files_of_a_folder_follow_their_names(spark, tmp_path):
    for name, count in (("b", 30), ("a", 3), ("c", 1)):
        write(tmp_path / f"{name}.csv", "url\n" + "".join(f"http://{name}/{i}\n" for i in range(count)))
    got = [u for _, u in listed(urls.read_urls(spark, str(tmp_path)))]
    assert got == [f"http://{n}/{i}" for n, c in (("a", 3), ("b", 30), ("c", 1)) for i in range(c)]


def test_max_urls(spark, tmp_path):
    path = write(tmp_path / "u.csv", "url\nhttp://a\nftp://b\nhttp://c\nhttp://d\n")
    assert listed(urls.read_urls(spark, path, Params(max_urls=2))) == [(0, "http://a"), (1, "http://c")]
    assert len(listed(urls.read_urls(spark, path, Params(max_urls=0)))) == 3
    with pytest.raises(ValueError):
        Params(max_urls=-1)


def test_each_file_has_its_own_header(spark, tmp_path):
    write(tmp_path / "a.csv", "Rank,URL\n1,http://a/1\n2,http://a/2\n")
    write(tmp_path / "b.csv", "\nURL,Rank\nhttp://b/1,1\nhttp://b/2,2\n")
    write(tmp_path / "c.csv", "x,y,url\n,,http://c/1\n")
    got = [u for _, u in listed(urls.read_urls(spark, str(tmp_path)))]
    assert got == ["http://a/1", "http://a/2", "http://b/1", "http://b/2", "http://c/1"]


def test_a_page_crawled_twice_counts_once(spark):
    listed_urls = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "ord bigint, url string")
    crawled = spark.createDataFrame([(1, "a", "old"), (7, "a", "new"), (3, "b", "B")], "ord bigint, url string, html string")
    rows = pages.look_up_pages(listed_urls, crawled).orderBy("ord").collect()
    assert [(r.ord, r.html) for r in rows] == [(0, "new"), (1, "B"), (2, "new")]
    found = analyze_url_list(listed_urls, crawled.withColumn("html", F.concat(F.lit("<p>"), F.repeat("html", 40))))
    assert sorted(r.ord for r in found.select("ord").collect()) == [0, 1, 2]


def test_good_pages_do_not_meet_the_second_attempt(spark):
    log = spark.createDataFrame([(0, "u", 200, None, "h")], LOG)
    plan = crawl.resolve_crawl(log, log)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Union" in plan


def test_first_urls_with_gaps(spark):
    df = spark.createDataFrame([(i, f"http://{i}") for i in (9, 2, 40, 7)], "ord bigint, url string")
    assert [o for o, _ in listed(urls.first_urls(df, Params(max_urls=3)))] == [2, 7, 9]
    assert urls.first_urls(df, Params(max_urls=0)).count() == 4


def test_missing_file_and_short_row_are_errors(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        urls.read_urls(spark, str(tmp_path / "none.csv"))
    path = write(tmp_path / "u.csv", "n,url,x\n1,http://a,2\n1,http://b\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        urls.read_urls(spark, path).collect()


LOG = "ord bigint, url string, status int, message string, html string"


def test_resolve_crawl(spark):
    nav, lost, slow = "Protocol error: navigation failed", "Execution context was destroyed", "Navigation TIMEOUT"
    first = [
        (0, "u0", 200, None, "h"), (1, "u1", 401, None, None), (2, "u2", 403, None, None),
        (3, "u3", 429, None, None), (4, "u4", None, None, None), (5, "u5", None, slow, None),
        (6, "u6", None, nav, None), (7, "u7", None, lost, None), (8, "u8", None, "boom", None),
        (9, "u9", 403, None, None), (10, "u10", 403, None, None), (11, "u11", 404, None, "h404"),
        (12, "u12", 403, None, None), (13, "403", 429, None, None),
    ]
    second = [(i, f"u{i}", 200, None, "f") for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 13)] + [
        (9, "u9", 500, None, None), (10, "u10", None, "refused", None)
    ]
    rows = crawl.resolve_crawl(
        spark.createDataFrame(first, LOG), spark.createDataFrame(second, LOG)
    ).orderBy("ord").collect()
    both = "Both Puppeteer and axios failed for "
    assert [(r.html, r.attempt, r.error) for r in rows] == [
        ("h", "primary", None),
        ("f", "fallback", None),
        ("f", "fallback", None),
        (None, None, "HTTP 429 for u3"),
        (None, None, "No response received for u4"),
        (None, None, "Timeout fetching u5"),
        ("f", "fallback", None),
        ("f", "fallback", None),
        (None, None, "Puppeteer failed for u8: boom"),
        (None, None, both + "u9: Request failed with status code 500"),
        (None, None, both + "u10: refused"),
        ("h404", "primary", None),
        (None, None, both + "u12: no response"),
        (None, None, "HTTP 429 for 403"),
    ]


def test_look_up_pages(spark):
    listed_urls = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c")], "ord bigint, url string")
    crawled = spark.createDataFrame([("a", "A"), ("b", None), ("z", "Z")], "url string, html string")
    rows = pages.look_up_pages(listed_urls, crawled).orderBy("ord").collect()
    assert [(r.html, r.error) for r in rows] == [
        ("A", None), (None, None), ("A", None), (None, "No response received for c")
    ]


def test_html_files(spark, tmp_path):
    write(tmp_path / "a.html", "<p>a\n</p>")
    write(tmp_path / "b.html", "<p>b</p>")
    got = {r.url.rsplit("/", 1)[1]: r.html for r in pages.read_html_files(spark, str(tmp_path)).collect()}
    assert got == {"a.html": "<p>a\n</p>", "b.html": "<p>b</p>"}


def test_page_scan_reads_needed_columns_only(spark):
    docs = pages.read_documents(spark, "/root/testdata/sf0.001/documents.parquet")
    plan = docs.select("ord", "text").where(F.col("text").startswith("A"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "StringStartsWith(text,A)" in plan


def test_filter_keeps_all_members_and_few_others(spark):
    rows = spark.range(40_000).select(F.concat(F.lit("u"), "id").alias("url"), (F.col("id") % 7).alias("k"), "id")
    members = rows.where("id % 10 = 3").select("url", "k")
    kept = {r.id for r in keep_possible_members(rows, members, ["url", "k"], bits=20).collect()}
    assert {i for i in range(40_000) if i % 10 == 3} <= kept and len(kept) < 4000 + 400
    # Over-full or tiny filters let more pass, and never lose a member.
    assert {r.id for r in keep_possible_members(rows, members, ["url", "k"], bits=15).collect()} >= {3, 13, 39_993}
    assert keep_possible_members(rows, members.limit(0), ["url", "k"]).count() == 0
    odd = spark.createDataFrame([("a", 1), (None, 2), ("", None)], "url string, k int")
    assert keep_possible_members(odd, odd, ["url", "k"]).count() == 3


def test_only_listed_pages_move(spark, tmp_path):
    rows = [(i, f"http://{i % 500}", f"<p>{i}</p>") for i in range(1000)]
    spark.createDataFrame(rows, "ord bigint, url string, html string").write.parquet(str(tmp_path / "pages"))
    crawled = spark.read.parquet(str(tmp_path / "pages"))
    wanted = spark.createDataFrame([(0, "http://7"), (1, "http://7"), (2, "http://9"), (3, "http://x"), (4, None)], "ord bigint, url string")
    found = pages.listed_pages(wanted, crawled)
    assert sorted((r.ord, r.url, r.html) for r in found.collect()) == [
        (507, "http://7", "<p>507</p>"), (509, "http://9", "<p>509</p>"),
    ]
    # In the plan the bitmaps lie between the scan that reads the HTML and the first exchange of it.
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "html" in line)
    above = [line for line in lines[:scan] if "html#" in line]
    assert "BroadcastHashJoin" in " ".join(lines[max(0, scan - 8):scan])
    exchanged = [line for line in above if "Exchange hashpartitioning" in line]
    assert not exchanged or "_order" in exchanged[-1]
    # Without ``ord`` the hash of a page decides.
    assert pages.listed_pages(wanted, crawled.drop("ord")).count() == 2


def test_first_urls_of_any_order(spark):
    import random

    draw = random.Random(4)
    for ords in (
        list(range(500)), [draw.randrange(-(2**63), 2**63) for _ in range(500)], [5] * 20 + list(range(6, 90)), [3], [],
        [-(2**63), 2**63 - 1, 0, 1, -1], list(range(0, 10**15, 10**13)),
    ):
        df = spark.createDataFrame([(o, f"http://{i}") for i, o in enumerate(ords)], "ord bigint, url string").repartition(3)
        expected = sorted((o, f"http://{i}") for i, o in enumerate(ords))
        for most in (7, 20, 499):
            got = [tuple(r) for r in urls.first_urls(df, Params(max_urls=most)).collect()]
            assert sorted(got) == expected[:most], (ords[:3], most)
    assert urls.first_urls(df, Params(max_urls=0)).count() == len(ords)


def test_first_urls_sort_and_store_nothing(spark, tmp_path):
    spark.range(10_000).selectExpr("id AS ord", "concat('http://', id) AS url").write.parquet(str(tmp_path / "u"))
    found = urls.first_urls(spark.read.parquet(str(tmp_path / "u")), Params(max_urls=100))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "LessThanOrEqual(ord,99)" in plan
    assert found.count() == 100


PAGE = "<html><head>{}<title>t</title></head><body>café naïve €</body></html>"


@pytest.mark.parametrize("content, expected", [
    (PAGE.format("").encode(), "é"),
    (b"\xef\xbb\xbf" + PAGE.format("<meta charset=latin1>").encode(), "é"),
    (b"\xff\xfe" + PAGE.format('<meta charset="utf-8">').encode("utf-16-le"), "é"),
    (b"\xfe\xff" + PAGE.format("").encode("utf-16-be"), "é"),
    (PAGE.format("").encode("cp1252"), "é"),
    (PAGE.format('<meta charset="ISO-8859-1">').encode("cp1252"), "é"),
    (PAGE.format("<META http-equiv=Content-Type content='text/html; charset = windows-1252'>").encode("cp1252"), "é"),
    (PAGE.format("<meta name=x><meta charset=iso-8859-15>").encode("iso-8859-15"), "é"),
    (PAGE.replace("é", "Ж").replace("ï", "ж").replace("€", "").format("<meta charset=koi8-r>").encode("koi8-r"), "Ж"),
    (PAGE.replace("é", "語").replace("ï", "").replace("€", "").format("<meta charset=Shift_JIS>").encode("cp932"), "語"),
    (PAGE.replace("é", "语").replace("ï", "").replace("€", "").format("<meta charset=gb2312>").encode("gb18030"), "语"),
    (PAGE.format("<!-- <meta charset=koi8-r> -->").encode("cp1252"), "é"),
    (PAGE.format("<meta charset=no-such>").encode("cp1252"), "é"),
    (PAGE.format("<meta charset=utf-7>").encode(), "é"),
    (PAGE.format("<meta charset=utf-16>").encode(), "é"),
    (PAGE.format("<meta charset=rot13><meta charset=unicode_escape>").encode(), "é"),
    (PAGE.format("<meta charset=utf-8>").encode("cp1252"), "\ufffd"),
    (PAGE.format("<meta charset=" + "é" + ">").encode(), "é"),
    (b"caf\xe9 " + b" " * 2000 + b"<meta charset=koi8-r>", "é"),
])
def test_encodings(content, expected):
    text = charset.decode_page(content)
    assert f"caf{expected}" in text and not text.startswith("\ufeff")


def test_files_of_several_encodings(spark, tmp_path):
    files = {"a.html": "café".encode(), "b.html": "café".encode("cp1252"), "d.html": b"\xff\xfe" + "café".encode("utf-16-le")}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r.url.rsplit("/", 1)[1]: r.html for r in pages.read_html_files(spark, str(tmp_path)).collect()}
    assert got == {"a.html": "café", "b.html": "café", "d.html": "café"}
    null = spark.createDataFrame([(None,)], "content binary").select(charset.decoded(F.col("content")).alias("t"))
    assert null.first().t is None
