"""Totals, thresholds, common keywords, topics and gaps against plain Python."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from termloom.functions.ranking import number_slices, sort_into_slices, with_rank
from termloom.functions.text import KEYWORD_STRUCT
from termloom.functions.joins import join_to_groups
from termloom.operators import aggregate, gap, topics
from termloom.operators.keywords import keywords
from termloom.params import Params
from termloom.vocab import TOPIC_SEEDS

SCHEMA = f"ord bigint, url string, n_chars bigint, error string, keywords {KEYWORD_STRUCT}, g string"


def page(ord_, words, error=None, group="x"):
    ranked = [(w, w.count(" ") + 1, s, i, i) for i, (w, s) in enumerate(words, 1)]
    return (ord_, f"http://p/{ord_}", 500, error, ranked, group)


def frame(spark, pages):
    return spark.createDataFrame(pages, SCHEMA)


def random_pages(seed, count=30, groups=("x",)):
    rng = random.Random(seed)
    base = ["visa", "fee", "work", "permit", "student", "rent", "tax", "house", "bank", "card"]
    terms = base + [f"{a} {b}" for a in base[:5] for b in base[:5] if a != b] + ["visa fee card"]
    pages = []
    for i in range(count):
        chosen = rng.sample(terms, rng.randint(0, 12))
        scores = sorted((rng.choice([5, 5, 9, 12, 20]) for _ in chosen), reverse=True)
        error = rng.choice([None, None, None, "", "HTTP 403 for u"])
        pages.append(page(i, zip(chosen, scores) if not error else [], error, rng.choice(groups)))
    return pages


def expected_common(pages, ratio):
    good = [p for p in pages if not p[3]]
    threshold = max(2, math.ceil(round(len(good) * ratio, 9)))
    df, total, first = defaultdict(int), defaultdict(int), {}
    for p in good:
        for w, _, s, r, _ in p[4]:
            df[w] += 1
            total[w] += s
            first.setdefault(w, (p[0], r))
    shared = sorted((w for w in df if df[w] >= threshold), key=lambda w: (-df[w], first[w]))
    phrase_words = {x for w in shared if " " in w for x in w.split()}
    kept = [w for w in shared if " " in w or w not in phrase_words]
    return threshold, df, total, first, kept


@pytest.mark.parametrize("seed,ratio", [(1, 0.5), (2, 0.2), (3, 0.1), (4, 0.34)])
def test_common_keywords(spark, seed, ratio):
    pages = random_pages(seed)
    threshold, df, total, first, kept = expected_common(pages, ratio)
    params = Params(common_ratio=ratio)
    found = frame(spark, pages)
    totals, stats = aggregate.keyword_totals(found), aggregate.page_stats(found, (), params)
    assert stats.first().threshold == threshold
    got = {r.keyword: (r.df, r.total, (r.first_ord, r.first_rank)) for r in totals.collect()}
    assert got == {w: (df[w], total[w], first[w]) for w in df}
    common = aggregate.common_keywords(totals, stats).orderBy("rank").collect()
    assert [(r.keyword, r.rank) for r in common] == [(w, i) for i, w in enumerate(kept, 1)]
    run = aggregate.run_stats(found, totals, aggregate.common_keywords(totals, stats), (), params).first()
    assert (run.n_keywords, run.n_common, run.threshold) == (len(df), len(kept), threshold)
    assert run.total_urls == run.processed_urls + run.failed_urls == len(pages)


def test_groups_are_independent_runs_and_null_is_a_group(spark):
    pages = random_pages(5, 60, ("a", "b", None))
    params = Params(common_ratio=0.2)
    found = frame(spark, pages)
    totals, stats = aggregate.keyword_totals(found, ["g"]), aggregate.page_stats(found, ["g"], params)
    rows = aggregate.common_keywords(totals, stats, ["g"]).collect()
    merged = topics.merged_topics(totals, TAXONOMY, ["g"]).collect()
    for g in ("a", "b", None):
        mine = [p for p in pages if p[5] == g]
        got = sorted((r.rank, r.keyword) for r in rows if r.g == g)
        assert got == list(enumerate(expected_common(mine, 0.2)[4], 1))
        ours = {(r.topic, r.topic_rank, r.rank, r.keyword, r.total) for r in merged if r.g == g}
        assert ours == expected_topics(mine)


@pytest.mark.parametrize("count,threshold", [(0, 2), (1, 2), (3, 2), (4, 2), (5, 3), (979, 490)])
def test_threshold(spark, count, threshold):
    got = spark.range(1).select(aggregate.threshold_of(F.lit(count)).alias("t")).first().t
    assert got == threshold


def test_threshold_is_exact_for_decimal_ratios(spark):
    got = spark.range(1).select(aggregate.threshold_of(F.lit(30), Params(common_ratio=0.1)).alias("t")).first().t
    assert got == 3


TAXONOMY = topics.Taxonomy.of({"Money": ("fee", "tax", "bank"), "Entry": ("visa", "permit"), "None": ()})


def topic_of(w):
    for i, (name, seeds) in enumerate(TAXONOMY.topics):
        if any(s in w for s in seeds):
            return i, name
    return 9, "General"


def expected_topics(pages):
    seen, order = {}, {}
    total = defaultdict(int)
    for p in (p for p in pages if not p[3]):
        for i, name in sorted({topic_of(k[0]) for k in p[4]}):
            order.setdefault(name, len(order) + 1)
        for w, _, s, r, _ in p[4]:
            seen.setdefault((topic_of(w)[1], w), (p[0], r))
            total[w] += s
    rows = set()
    for name in order:
        words = sorted((w for t, w in seen if t == name), key=lambda w: (-total[w], seen[name, w]))
        inside = {x for w in words if " " in w for x in w.split()}
        kept = [w for w in words if " " in w or w not in inside]
        rows |= {(name, order[name], i, w, total[w]) for i, w in enumerate(kept, 1)}
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merged_topics(spark, seed):
    pages = random_pages(seed)
    rows = topics.merged_topics(aggregate.keyword_totals(frame(spark, pages)), TAXONOMY).collect()
    assert {(r.topic, r.topic_rank, r.rank, r.keyword, r.total) for r in rows} == expected_topics(pages)


def test_first_topic_wins_and_seeds_match_inside_words(spark):
    words = ["current", "coffee shop", "thousand", "settlement", "family sponsorship", "cost living",
             "national park", "plain", "blue card", "work visa canada"]
    df = frame(spark, [page(1, [(w, 9) for w in words])])
    got = {r.keyword: r.topic for r in topics.keyword_topics(df).collect()}
    assert got == {
        "current": "Relocation & Settlement", "coffee shop": "Costs & Fees", "thousand": "Country-Specific",
        "settlement": "Permanent Residency", "family sponsorship": "Work Permits", "cost living": "Costs & Fees",
        "national park": "Citizenship & Naturalization", "plain": "General", "blue card": "EU Blue Card",
        "work visa canada": "Work Permits",
    }
    assert len(TOPIC_SEEDS) == 11 and sum(map(len, TOPIC_SEEDS.values())) == 142


def test_topics_by_table_equal_topics_by_plan(spark):
    seeds = [(1, "A", "ent"), (2, "B", "a"), (2, "B", "visa"), (3, "C", None), (4, "D", "ta")]
    df = frame(spark, [page(1, [(w, 9) for w in ("current", "tax", "other", "visa fee", "Plain", "x")])])
    table = spark.createDataFrame(seeds, "topic_order int, topic string, seed string")
    plan = topics.Taxonomy.of({"A": ["ent"], "B": ["a", "visa"], "C": [], "D": ["ta"]})
    rows = keywords(df)
    one = topics.assign_topics(rows, plan).select("keyword", "topic_order", "topic").collect()
    two = topics.assign_topics_by_table(rows, table).select("keyword", "topic_order", "topic").collect()
    assert sorted(one) == sorted(two)


def test_table_form_equals_plan_form_on_random_seeds(spark):
    draw = random.Random(9)
    words = ["rent", "rents", "visa", "fee", "tax", "a", "ta", "low", "x y"]
    names = {" ".join(draw.choices(words, k=draw.randint(1, 4))) for _ in range(120)} | {"Rent Visa", "low  rent", ""}
    rows = spark.createDataFrame([(n,) for n in sorted(names)] * 2 + [(None,)], "keyword string")
    for match in ("substring", "word"):
        for seed_sets in ([["rent"], ["visa fee", "ta"]], [["tax low", "x"], [], ["a", "rents", "nt vi"]], [["y rent x"], [""]]):
            plan = topics.Taxonomy.of({f"T{i}": s for i, s in enumerate(seed_sets)}, match=match)
            listed = [(i, f"T{i - 1}", seed) for i, s in enumerate(seed_sets, 1) for seed in s] + [(len(seed_sets), "T9", None)]
            table = spark.createDataFrame(listed, "topic_order int, topic string, seed string")
            one = topics.assign_topics(rows, plan).where("keyword is not null").collect()
            two = topics.assign_topics_by_table(rows, table, match=match).where("keyword is not null").collect()
            assert sorted(map(tuple, one)) == sorted(map(tuple, two)), (match, seed_sets)
    with pytest.raises(ValueError):
        topics.assign_topics_by_table(rows, table, match="prefix")


def test_many_seeds_take_one_join_on_the_seed(spark):
    seeds = spark.range(100_000).selectExpr(
        "cast(id % 500 + 1 AS int) AS topic_order", "concat('T', id % 500 + 1) AS topic", "concat('seed', id) AS seed"
    )
    rows = spark.range(3000).selectExpr("concat('seed', id * 40, ' other') AS keyword")
    for match in ("substring", "word"):
        found = topics.assign_topics_by_table(rows, seeds, match=match)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join Inner, (seed#") == 1 and "Cartesian" not in plan
        got = {r.keyword: r.topic_order for r in found.collect()}
        assert len(got) == 3000
        for name, order in got.items():
            number = name.split()[0][4:]
            # By substring, a seed with fewer digits lies inside as well.
            inside = [number] if match == "word" else [number[:k] for k in range(1, len(number) + 1)]
            assert order == min(int(n) % 500 + 1 for n in inside if int(n) < 100_000 and str(int(n)) == n) if any(
                int(n) < 100_000 for n in inside) else order == 501


def test_seeds_as_whole_words(spark):
    df = frame(spark, [page(1, [(w, 9) for w in ("current", "rent", "rent cost", "low rent", "rents")])])
    taxonomy = topics.Taxonomy.of({"A": ["rent"]}, match="word")
    got = {r.keyword: r.topic for r in topics.keyword_topics(df, taxonomy).collect()}
    assert got == {"current": "General", "rent": "A", "rent cost": "A", "low rent": "A", "rents": "General"}
    with pytest.raises(ValueError):
        topics.Taxonomy.of({"A": ["rent"]}, match="prefix")


def test_taxonomy_from_rows_has_no_limit(spark):
    rows = [(2, "B", "y"), (1, "A", "x"), (2, "B", "z")]
    assert topics.Taxonomy.from_rows(rows).topics == (("A", ("x",)), ("B", ("y", "z")))
    many = topics.Taxonomy.of({"A": [f"seed{i}" for i in range(6_000)], "B": ["plain"]})
    df = frame(spark, [page(1, [("seed5999", 9), ("plain", 5)])])
    assert {r.keyword: r.topic for r in topics.keyword_topics(df, many).collect()} == {"seed5999": "A", "plain": "B"}


def test_page_counters(spark):
    df = frame(spark, [page(1, [("visa", 9), ("tax", 5), ("other", 5), ("visa fee", 3)]), page(2, [], "HTTP 401 for u")])
    got = [(r.ord, r.n_keywords, r.n_topics, r.error) for r in aggregate.page_counters(df, TAXONOMY).orderBy("ord").collect()]
    assert got == [(1, 4, 3, None), (2, 0, 0, "HTTP 401 for u")]


@pytest.mark.parametrize("seed", [1, 2])
def test_gap_sections(spark, seed):
    pages = random_pages(seed, 40)
    params = Params(common_ratio=0.3, gap_items=6)
    threshold, df, total, first, kept = expected_common(pages, 0.3)
    good = [p for p in pages if not p[3]]
    found = frame(spark, pages)
    totals, stats = aggregate.keyword_totals(found), aggregate.page_stats(found, (), params)

    def items(section):
        return [r.item for r in section.orderBy("rank").collect()]

    assert items(gap.gap_common(totals, stats, (), params)) == sorted(kept, key=lambda w: (-df[w], -total[w], w))[:6]
    rare = [w for w in df if df[w] < threshold]
    assert items(gap.gap_underutilized(totals, stats, (), params)) == sorted(
        rare, key=lambda w: (-total[w] / df[w], df[w], w))[:6]
    assert items(gap.gap_long_tail(totals, stats, (), params)) == sorted(
        (w for w in rare if " " in w), key=lambda w: (-len(w.split()), -total[w], w))[:6]

    shared = {w for w in df if df[w] >= threshold}
    pairs = defaultdict(int)
    for p in good:
        have = [k[0] for k in p[4]]
        for b in have:
            for a in have:
                if a in kept and b not in shared:
                    pairs[b, a] += 1
    best = {}
    for (b, a), n in pairs.items():
        if n >= 2:
            key = (-(len(good) * n) / (df[a] * df[b]), -n, a)
            best[b] = min(best.get(b, key), key)
    expected = sorted(best, key=lambda b: (best[b][0], best[b][1], b))[:6]
    got = gap.gap_semantic(found, totals, stats, (), params).orderBy("rank").collect()
    assert [(r.item, r.seed) for r in got] == [(b, best[b][2]) for b in expected]

    missing = {(r.ord, r.rank, r.item) for r in gap.gap_missing(found, totals, stats).collect()}
    assert missing == {
        (p[0], i, w)
        for p in good
        for i, w in enumerate([w for w in kept if w not in {k[0] for k in p[4]}], 1)
    }


@pytest.mark.parametrize("group", [[], ["g"]])
def test_pairs_are_exchanged_without_the_name_of_the_seed(spark, group):
    """A seed is its place in the list of common keywords until the pairs are counted."""
    found = frame(spark, random_pages(4, 30)).withColumn("g", F.when(F.col("ord") % 2 == 0, "even"))
    totals, stats = aggregate.keyword_totals(found, group), aggregate.page_stats(found, group)
    rows = gap.gap_semantic(found, totals, stats, group)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    counted = [line for line in plan.splitlines() if "Aggregate" in line and "n_ab" in line]
    assert len(counted) == 1 and "place#" in counted[0] and "seed" not in counted[0]


def test_gap_with_nothing_common(spark):
    found = frame(spark, [page(1, [("a b", 9), ("cc", 5)]), page(2, [("dd", 5)])])
    totals, stats = aggregate.keyword_totals(found), aggregate.page_stats(found)
    rows = gap.keyword_gap(found, totals, stats).collect()
    assert {(r.section, r.item) for r in rows} == {
        ("underutilized_opportunities", "a b"), ("underutilized_opportunities", "cc"),
        ("underutilized_opportunities", "dd"), ("long_tail_opportunities", "a b"),
    }


def test_a_cold_group_is_not_copied(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "g string, v int")
    groups = spark.createDataFrame([("a", 10), (None, 20)], "g string, w int")
    joined = join_to_groups(rows, groups, ["g"])
    assert sorted((r.v, r.w or 0) for r in joined.collect()) == [(1, 10), (2, 10), (3, 20), (4, 0)]
    assert "Generate" not in joined._jdf.queryExecution().executedPlan().toString()


def test_one_scalar_subquery_for_all_statistics(spark):
    found = frame(spark, random_pages(3, 20))
    totals, stats = aggregate.keyword_totals(found), aggregate.page_stats(found)
    both = aggregate.with_stats(totals, stats, ["threshold", "processed_urls"])
    both.collect()
    plan = both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("\n") and plan.count(":- Subquery") + plan.count("+- Subquery") <= 1 + plan.count("ReusedSubquery")


def test_rank_spreads_a_hot_group(spark):
    # One group holds nine tenths of the rows; no slice may hold it whole.
    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 7).alias("g"), F.xxhash64("id").alias("v"), "id"
    )
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # it would merge slices this small
    spark.conf.set(key, "false")
    try:
        sliced = sort_into_slices(df, ["g"], [F.desc("v")])
        biggest = sliced.groupBy("g", "_slice").count().agg(F.max("count")).first()[0]
        rows = number_slices(sliced, ["g"], [F.desc("v")], "rank").collect()
    finally:
        spark.conf.unset(key)
    assert biggest < 9_000
    by_group = defaultdict(list)
    for r in rows:
        by_group[r.g].append((r.rank, -r.v))
    assert len(rows) == 20_000 and len(by_group[None]) == 18_000
    for pairs in by_group.values():
        pairs.sort()
        assert [n for n, _ in pairs] == list(range(1, len(pairs) + 1))
        assert [v for _, v in pairs] == sorted(v for _, v in pairs)


def test_rank_of_nothing(spark):
    empty = spark.range(0).select("id")
    assert with_rank(empty, [], [F.asc("id")], "n").count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_results_do_not_depend_on_partitioning(spark, partitions):
    pages = random_pages(9, 50)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = frame(spark, pages).repartition(partitions)
        rows = topics.merged_topics(aggregate.keyword_totals(found), TAXONOMY).collect()
        assert {(r.topic, r.topic_rank, r.rank, r.keyword, r.total) for r in rows} == expected_topics(pages)
        totals = aggregate.keyword_totals(found)
        assert totals.agg(F.sum("df")).first()[0] == sum(len(p[4]) for p in pages)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
