"""Source divergence, toxicity and the conversation trie, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from termloom.llm import conversations, divergence, unlabelled

# --- source divergence


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, least=3, ranks=200):
    counts, holders, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate(UPPER) for t in TERM.findall(text or "")]
        counts[lang, source].update(terms)
        holders[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in holders[lang].items() if n >= least]
        size = len(kept)

        def shares(name):
            own = counts[lang, name] if name is not None else sum((counts[g] for g in groups if g[0] == lang), Counter())
            n = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 1) // (n + size) for t in kept}

        p = shares(source)
        parts = {"pair": [], "term": []}
        for other in {s for la, s in groups if la == lang} - {source}:
            q = shares(other)
            parts["pair"].append((-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), other))
        q = shares(None)
        for t in kept:
            if counts[lang, source][t] and p[t] > q[t]:
                parts["term"].append((-((p[t] - q[t]) ** 2 // q[t]), t))
        for part, items in parts.items():
            items.sort(key=lambda x: (x[0], x[1].encode()))
            for rank, (value, item) in enumerate(items[: ranks if part == "term" else None], 1):
                out.append((lang, source, part, item, -value, rank))
    return out


def random_sources(seed, count=400):
    draw = random.Random(seed)
    vocabulary = [draw.choice("abcdé中ß😀") * draw.randint(1, 3) + draw.choice(["", "X", "y", "Ö", "ö"]) for _ in range(60)]
    rows = []
    for _ in range(count):
        lang = draw.choice(["en", "en", "en", "de", None, ""])
        source = draw.choice(["hot"] * 5 + ["s1", "s2", None, "só"])
        text = draw.choice(["", " ", "1"]).join(
            draw.choice(vocabulary) + draw.choice([" ", "-", "\n", "7", "\0", "\x7f"]) for _ in range(draw.randint(0, 12))
        )
        rows.append((lang, source, draw.choice([text, text, text, None, ""])))
    return rows + [("xx", "lone", "only twice only"), ("xx", "pair", "only"), ("yy", "void", None)] + rows[:20]


def audited(spark, rows, **settings):
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    # Columns of other operators' or of this one's own names do not disturb.
    df = df.withColumns({"term": F.lit("t"), "count": F.lit(3), "docs": F.lit(4), "value": F.lit(5), "p": F.lit(6)})
    return sorted(tuple(r) for r in divergence.audit_sources(df, **settings).collect())


def test_audit_equals_brute_force(spark):
    rows = random_sources(1)
    assert audited(spark, rows) == sorted(plain_audit(rows))
    assert audited(spark, rows, ranks=7, least_docs=2) == sorted(plain_audit(rows, 2, 7))


def test_audit_passes_sums_on_early(spark, monkeypatch):
    """Tasks that hold few terms and pairs hand on more rows; the sums stay the same."""
    rows = random_sources(2, 150) + [("en", "long", "ab " * 9000 + "cd")] * 3

    def sums(kind, batches):
        monkeypatch.setattr(divergence, "_HELD", 40)
        monkeypatch.setattr(divergence, "_PIECE", 100)
        total = Counter()
        for b in kind(iter(batches)):
            for lang, source, term, count, docs in zip(*[b[n].to_pylist() for n in b.schema.names]):
                total[lang, source, term] += count + 1000 * docs
        return total

    import pyarrow as pa

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("text", pa.string())])
    batch = pa.RecordBatch.from_arrays([pa.array([(r[k] or "") for r in rows]) for k in range(3)], schema=schema)
    expected = Counter()
    for lang, source, text in rows:
        terms = [t.translate(UPPER) for t in TERM.findall(text or "")]
        for t, n in Counter(terms).items():
            expected[lang or "", source or "", t] += n + 1000
    assert sums(divergence.count_terms, [batch.slice(0, 60), batch.slice(60)]) == expected


def test_audit_of_nothing(spark):
    assert audited(spark, [("a", "b", "c")])[1:] == []  # no pair, no kept term
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit_sources(empty).count() == 0


# --- toxicity


def plain_risk(x, toxic, weights, prior):
    """The risk and both its parts of dense rows, by the definition."""
    margin = x @ weights[:-1] + weights[-1]
    loss = lambda z: np.log1p(np.exp(-z))
    plus, minus = loss(margin[toxic]).mean(), loss(-margin[toxic]).mean()
    return prior * plus, loss(-margin).mean() - prior * minus


def test_risk_gradient_equals_differences():
    draw = np.random.default_rng(3)
    x = (draw.random((60, 7)) < 0.4).astype(float)
    toxic = draw.random(60) < 0.3
    flat, lengths = np.nonzero(x)[1], x.sum(axis=1).astype(int)
    seen = set()
    for scale, prior in ((0.1, 0.2), (1.0, 0.2), (6.0, 0.9), (12.0, 0.95)):
        for _ in range(10):
            weights = draw.normal(size=8) * scale
            sums = unlabelled.risk_sums(flat, lengths, toxic.astype(int), weights)
            found = unlabelled.risk_gradient(sums, toxic.sum(), 60, prior, 0.0)
            falls = plain_risk(x, toxic, weights, prior)[1] < 0
            seen.add(falls)

            def objective(w):
                found_part, clean = plain_risk(x, toxic, w, prior)
                return -clean if falls else found_part + clean

            steps = np.eye(8) * 1e-5
            expected = [(objective(weights + s) - objective(weights - s)) / 2e-5 for s in steps]
            assert np.allclose(found, expected, atol=1e-6)
    assert seen == {True, False}  # both sides of the correction


def toxic_texts(draw, count):
    plain = [f"word{k}" for k in range(300)]
    insults = ["idiot", "scum", "Blödmann", "blödmannes", "blödheit"]
    rows = []
    for k in range(count):
        bad = draw.random() < 0.25
        words = draw.choices(plain, k=draw.randint(5, 60)) + (draw.choices(insults, k=3) if bad else [])
        draw.shuffle(words)
        rows.append((k, " ".join(words), int(bad)))
    return rows


def test_toxicity_of_unseen_texts(spark):
    rows = toxic_texts(random.Random(5), 1500)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(6)
    # Labels of held-out rows say the opposite: they must not be read.
    held = {k for k, _, _ in rows if crc32(str(k).encode()) % 4 == 2}
    labels = spark.createDataFrame(
        [(k, 1 - t if k in held else t) for k, _, t in rows if k % 2], "doc_id bigint, toxic int"
    )
    use = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    model, words = unlabelled.fit_toxicity(docs, labels, use)
    scores = {r.doc_id: r.s for r in words.select("doc_id", unlabelled.score_column(model, F.col("words")).alias("s")).collect()}
    assert len(scores) == 1500 and all(0 <= s <= 1 for s in scores.values())
    right = [(scores[k] >= 0.3) == bool(t) for k, _, t in rows if k in held]
    assert sum(right) >= 0.97 * len(right)
    assert 0.2 < model.prior < 0.3


def test_toxicity_sums_do_not_depend_on_partitions(spark):
    rows = toxic_texts(random.Random(6), 300)
    labels = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id bigint, toxic int")
    got = []
    for parts in (1, 7):
        docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(parts)
        got.append(unlabelled.fit_toxicity(docs, labels)[0])
    assert np.array_equal(got[0].chosen, got[1].chosen) and np.allclose(got[0].weights, got[1].weights)


def test_toxicity_odd_rows(spark):
    rows = [(r[0], r[1]) for r in toxic_texts(random.Random(7), 200)]
    labelled = [(k, t) for k, _, t in toxic_texts(random.Random(7), 200)]
    odd = [(None, "idiot scum"), (None, None), (900, None), (901, ""), (902, " \n"), (5, "again"), (5, "again"),
           (903, "idiot " * 50_000), (904, "x" * 300_000)]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string").withColumns(
        {"toxic": F.lit("t"), "words": F.lit(1), "_toxic": F.lit(2), "doc": F.lit(3)}
    )
    labels = spark.createDataFrame(
        labelled + [(None, 1), (3, None), (7, 0), (7, 1), (12345, 1)], "doc_id bigint, toxic int"
    )
    model, words = unlabelled.fit_toxicity(docs, labels)
    scored = words.select("doc_id", unlabelled.score_column(model, F.col("words")).alias("s")).collect()
    assert len(scored) == 209 and all(r.s is not None and 0 <= r.s <= 1 for r in scored)
    by_id = {r.doc_id: r.s for r in scored}
    assert by_id[900] == by_id[901] == by_id[902] < by_id[903]
    for none in (labels.limit(0), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        model, words = unlabelled.fit_toxicity(docs, none)
        assert model is None
        assert {r.s for r in words.select(unlabelled.score_column(model, F.col("words")).alias("s")).collect()} == {0.0}
    model, words = unlabelled.fit_toxicity(docs.limit(0), labels)
    assert model is None and words.count() == 0


def test_buckets_of_a_text():
    some = unlabelled.Settings(buckets=1 << 30)
    one = set(unlabelled.text_buckets("Idiot idiots", some))
    assert set(unlabelled.text_buckets("idiots IDIOT! idiot", some)) == one
    assert unlabelled.text_buckets(None) == unlabelled.text_buckets("") == unlabelled.text_buckets("_ -") == []
    # Two words with the stem are a mark that one alone is not.
    assert one - set(unlabelled.text_buckets("idiot", some)) - set(unlabelled.text_buckets("idiots", some))


# --- conversation trie


def plain_trie(rows, every=100, most=6):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append(((turn is not None, turn or 0), key, role, text))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in turns:
        h = crc32(str(c).encode()) % most
        base = c - int(np.fmod(c, every))
        rebuilt[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(path[:-1] for path in members if path)
    out = []
    for path, of in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = ",".join(str(c) for c in sorted(of) if rebuilt[c] == path)
        out.append((
            min(of), len(path), min(members[path[:-1]]) if path else None, len(of), children[path],
            sum(not children[p] for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def random_turns(seed, count=260):
    draw = random.Random(seed)
    rows = []
    for c in range(count):
        conv = draw.choice([c, c + 100, -c, 100 * c])
        for turn in range(draw.randint(1, 7)):
            text = draw.choice(["hi", "hi", "é😀", "", None, "again " * draw.randint(1, 2)])
            rows.append((conv, draw.choice([turn, turn, turn, turn, None, 1]), draw.choice(["user", "bot", None, ""]), text))
    rows += [(5000 + c, t, "user", "same") for c in range(120) for t in range(6)]  # a hot path
    rows += [(7000, t, "user", f"turn {t}") for t in range(300)]
    return rows + [(None, 1, "user", "x"), (None, None, None, None)] + rows[:5]


def trie(spark, rows, parts=6):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(parts)
    df = df.withColumns({"path": F.lit(1), "keys": F.lit(2), "n_convs": F.lit(3), "_slice": F.lit(4), "depth": F.lit(5)})
    return sorted((tuple(r) for r in conversations.prefix_trie(df).collect()), key=str)


def test_trie_equals_brute_force(spark):
    rows = random_turns(1)
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_over_many_shards(spark):
    """More shards than paths of some nodes: most of the upper trie is skeleton."""
    rows = random_turns(2, 120)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        for name, value in zip(names, ("40", "false")):
            spark.conf.set(name, value)
        assert trie(spark, rows) == plain_trie(rows)
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def test_trie_of_little(spark):
    for rows in ([(3, 0, "a", "b")], [(200, 0, "a", "b"), (205, 0, "x", "y")], [(1, None, None, None)] * 3):
        assert trie(spark, rows, 1) == plain_trie(rows)
    assert trie(spark, [], 1) == [] and trie(spark, [(None, 0, "a", "b")], 1) == []


def test_skeleton_holds_what_shards_share():
    def path(*turns):
        return b"".join(bytes([t]) * conversations.KEY_BYTES for t in turns)

    shards = [[path(), path(1), path(1, 2)], [path(1, 2, 3), path(1, 4)], [path(5), path(6)]]
    skeleton = conversations.Skeleton()
    for before, after in zip(shards, shards[1:]):
        n = conversations._common_turns(before[-1], after[0])
        skeleton.add(after[0][: n * conversations.KEY_BYTES])
    assert skeleton.depth == [0, 1, 2]  # the root, (1) and (1, 2)
    rows = list(conversations.shard_nodes(skeleton, ((s, i, p) for s, shard in enumerate(shards) for i, p in enumerate(shard))))
    finished = [r for r in rows if r[0] == "node"]
    assert sorted((r[1], r[3]) for r in finished) == [(0, 1), (0, 1), (1, 2), (2, 3)]
    assert sum(r[0] == "end" for r in rows) == 3
