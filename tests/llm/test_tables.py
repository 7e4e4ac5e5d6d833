"""Operators that compare, count or order whole tables, against brute force."""

import email
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termloom.llm import components, fourier, hamming, jaccard, mixing, recurrent, running, warc
from termloom.llm.words import lower_words


class Classes:
    """Union of the members of linked pairs; the smallest names the class."""

    def __init__(self, members):
        self.parent = {m: m for m in members}

    def root(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def test_components_equal_brute_force(spark):
    draw = random.Random(2)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(170)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, None), (None, None)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r.node: r.component for r in components.connected_components(df).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    classes = Classes({x for e in real for x in e})
    for a, b in real:
        classes.join(a, b)
    assert found == {m: classes.root(m) for m in classes.parent}
    assert components.connected_components(df.limit(0)).count() == 0


def test_running_sums(spark):
    rows = [(g, i, (i * 7) % 5) for g in ("a", None, "b") for i in range(40 if g == "a" else 3)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(4)
    found = running.with_running_sums(df, ["g"], [F.col("i")], {"before": "v"}).collect()
    for g in ("a", None, "b"):
        own = sorted((r.i, r.v, r.before) for r in found if r.g == g)
        assert [x[2] for x in own] == [sum(v for _, v, _ in own[:k]) for k in range(len(own))]


# --- archives


@pytest.mark.parametrize("url, target", [
    ("http://x.org/a%20b?q=%C3%A9", "http://x.org/a%20b?q=%C3%A9"),
    ("http://x.org/a%20b?q=%C3%A9 z", "http://x.org/a%20b?q=%C3%A9%20z"),
    ("http://x.org/100%?a=é", "http://x.org/100%25?a=%C3%A9"),
    ("http://x.org/%zz%4", "http://x.org/%25zz%254"),
    ("http://x.org/[1]|{2}~", "http://x.org/[1]|{2}~"),
    ("a\r\nWARC-Type: other", "a%0D%0AWARC-Type:%20other"),
])
def test_headers_hold_the_url_as_readers_take_it(url, target):
    raw = warc.warc_record(5, url, b"x", None, False)
    headers = email.message_from_bytes(raw.partition(b"\r\n")[2])  # another parser's view
    assert headers.get_all("WARC-Target-URI") == [target] and headers["WARC-Type"] == "response"
    assert (headers[warc.SOURCE_URL] is None) == (url == target)
    assert warc.parse_record(raw)["url"] == url


def test_one_page_id_with_two_payloads(spark, tmp_path):
    rows = [(1, "u", "a" * 2000), (1, "u", "b" * 2000), (1, "v", "b" * 2000), (0, "w", "a" * 2000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = str(tmp_path / "w")
    found = warc.read_records(warc.write_archives(pages, folder), folder).collect()
    assert Counter((r.page_id, r.url, r.record_type, r.refers_to) for r in found) == Counter(
        [(1, "u", "response", None), (1, "u", "response", None), (1, "v", "response", None), (0, "w", "revisit", 1)]
    )


def test_archives_round_trip(spark, tmp_path):
    long, html = "é" * 700, "<p>" + "x" * 1500
    rows = [(1, "http://a/ b%20c\r\n", long, 0), (2, None, long, 0), (9, "http://é", long, 0), (4, "u", "small", 0)]
    rows += [(5, "u", "small", 0), (6, "u", None, 0), (7, "u", "", 0), (None, "u", html, 0), (8, "u", html, 0)]
    rows += [(8, "u", html, 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload int").repartition(3)
    layout = warc.Layout(frame_bytes=2000, bundle_bytes=1500)
    folder = str(tmp_path / "archives")
    index = warc.write_archives(pages, folder, layout)
    found = warc.read_records(index, folder).collect()
    assert len(found) == len(rows)
    expected = Counter()
    for page_id, url, text, _ in rows:
        raw = (text or "").encode()
        last = {long: 9, html: 8}.get(text)
        refers = last if last is not None and page_id != last else None
        kind = "revisit" if refers is not None else "response"
        expected[page_id, url, kind, refers, len(raw), hashlib.sha1(raw).hexdigest()] += 1
        for record in found:
            if record.page_id == page_id and record.record_type == "response":
                assert bytes(record.payload) == raw
    got = Counter(
        (r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in found
    )
    assert got == expected
    wanted = spark.createDataFrame([(4,), (6,), (77,)], "page_id bigint")
    some = warc.read_records(warc.lookup(index, wanted), folder).collect()
    assert sorted(r.page_id for r in some) == [4, 6]
    assert warc.read_records(warc.write_archives(pages.limit(0), folder), folder).count() == 0


def test_bundles_are_plain_zstandard_files(spark, tmp_path):
    import zstandard

    pages = spark.range(20).selectExpr("id as page_id", "'u' as url", "repeat('ab', 400) as html")
    warc.write_archives(pages.coalesce(1), str(tmp_path), warc.Layout(frame_bytes=3000))
    (bundle,) = tmp_path.glob("*.warc.zst")
    raw = zstandard.ZstdDecompressor().stream_reader(bundle.open("rb"), read_across_frames=True).read()
    assert raw.count(b"WARC/1.1\r\n") == 20


# --- mixing


def fill_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    wanted, full = share * sum(sizes.values()), set()
    while True:
        rest = wanted - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        targets = {s: most * sizes[s] if s in full else rest * weight[s] / open_weight for s in names}
        over = {s for s in names if s not in full and targets[s] > most * sizes[s] + 1e-9}
        if not over:
            return targets
        full |= over


def test_mix(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice(["b", "a", None, "é", "ab", "Z"]), draw.choice([0, 1, 3, 40, 200])) for i in range(300)]
    rows += [(500, "big", 5000), (1, "a", 40), (1, "a", 40), (None, "a", 7), (600, "none", 0)]
    docs = spark.createDataFrame(
        [(i, s, " ".join(["w"] * n) if n else None, 3) for i, s, n in rows],
        "doc_id bigint, source string, text string, size int",
    ).repartition(4)
    mix = mixing.Mix(block_words=16)
    mixed, slots = mixing.mix_documents(docs, mix)
    found = mixed.collect()
    assert Counter((r.doc_id, r.source, r.size) for r in found) == Counter(rows)
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    targets = fill_targets(sizes)
    taken = Counter()
    for r in found:
        assert r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 1
    again = mixing.mix_documents(docs.repartition(2), mix)[0].collect()
    assert Counter(found) == Counter(again)
    order = [r.place for r in slots.orderBy("slot").collect()]
    assert [r.slot for r in slots.orderBy("slot").collect()] == list(range(len(order)))
    share = Counter(order)
    for place, count in share.items():  # any stretch has close to its share of the slots
        for start in range(0, len(order) - 50, 25):
            assert abs(order[start : start + 50].count(place) - 50 * count / len(order)) <= 4
    assert mixing.mix_documents(docs.limit(0), mix)[0].count() == 0


# --- near copies of texts


def brute_components(docs):
    sets = {}
    for i, text in docs:
        w = lower_words(text)
        sets[i] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set()
    classes, ids = Classes(sets), list(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                classes.join(ids[x], ids[y])
    return {i: (len(sets[i]), classes.root(i)) for i in sets}


def varied_texts(count):
    draw = random.Random(5)
    voc = [f"w{i}" for i in range(2000)]
    base = [[draw.choice(voc) for _ in range(draw.randint(1, 120))] for _ in range(30)]
    passage = [draw.choice(voc) for _ in range(60)]
    docs = [(5000, None), (5001, ""), (5002, " \n"), (5003, "w1 " * 3000), (5004, "W1 " * 3000)]
    for i in range(count):
        own, kind = list(draw.choice(base)), draw.random()
        if kind < 0.3:
            for _ in range(draw.randint(0, 4)):
                own[draw.randrange(len(own))] = draw.choice(voc)
        elif kind < 0.5:
            own = own[: max(1, int(len(own) * draw.uniform(0.6, 1)))]
        elif kind < 0.6:
            own = passage + own
        elif kind < 0.7:
            own = [draw.choice(voc) for _ in range(draw.randint(1, 8))]
        docs.append((i * 3, " ".join(own).upper() if kind > 0.9 else " ".join(own)))
    return docs


@pytest.mark.parametrize("join", [jaccard.Join(), jaccard.Join(cell_bits=4, filter_bits=6, group_shingles=200)])
def test_shingle_components_equal_brute_force(spark, join):
    docs = varied_texts(400)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, n_shingles int").repartition(4)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.shingle_components(df, join).collect()}
    assert found == brute_components(docs)


def test_shingle_components_of_odd_tables(spark):
    df = spark.createDataFrame([(3, "a b"), (3, "a b"), (None, "A b"), (None, "x")], "doc_id bigint, text string")
    found = Counter(tuple(r) for r in jaccard.shingle_components(df).collect())
    assert found == Counter({(3, 1, 3): 2, (None, 1, 3): 1, (None, 1, None): 1})
    assert jaccard.shingle_components(df.limit(0)).count() == 0


def test_divide_skip_equals_counting():
    draw = random.Random(6)
    for _ in range(200):
        lists = [sorted(draw.sample(range(30), draw.randint(0, 20))) for _ in range(draw.randint(1, 12))]
        needed = draw.randint(1, len(lists))
        counts = Counter(x for own in lists for x in own)
        assert jaccard.divide_skip(lists, needed) == {x: c for x, c in counts.items() if c >= needed}


# --- near copies of vectors


def test_near_duplicates_equal_brute_force(spark):
    draw = np.random.default_rng(7)
    base = draw.normal(size=(40, 24))
    rows = []
    for i in range(500):
        vector = base[draw.integers(40)] + draw.normal(size=24) * draw.choice([0.0, 0.1, 0.25, 3.0])
        rows.append((i, [float(x) for x in np.float32(vector)], int(draw.integers(2))))
    zero, bad = [0.0] * 24, [1.0] * 23
    rows += [(900, None, 1), (901, zero, 1), (902, [*bad, float("nan")], 1), (903, [*bad, None], 1), (904, [], 1)]
    rows += [(905, rows[0][1], None), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, [*bad, float("inf")], 0)]
    rows += [(None, rows[0][1], 0)]
    df = spark.createDataFrame(
        [(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, label int, n_links int"
    ).repartition(4)
    for search in (hamming.Search(recall=0.9999), hamming.Search(recall=0.9999, block=16), hamming.Search(recall=0.9999, row_cost=1, bucket=1)):
        found = hamming.near_duplicates(df, search).collect()
        assert len(found) == len(rows)
        got = {r.vec_id: r for r in found}
        links = defaultdict(set)
        for x in range(500):
            for y in range(x):
                a, b = np.array(rows[x][1], float), np.array(rows[y][1], float)
                if rows[x][2] == rows[y][2] and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                    links[x].add(y)
                    links[y].add(x)
        assert all(got[i].n_links <= len(links[i]) for i in range(500))
        assert sum(got[i].n_links for i in range(500)) >= 0.98 * sum(map(len, links.values()))
        assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, 905, 908))
        assert got[None].n_links == 0 and got[None].component_id is None
        assert (got[906].n_links, got[907].component_id, got[907].kept) == (1, 906, False)
    assert hamming.near_duplicates(df.limit(0)).count() == 0


def test_codes_near_each_other_equal_brute_force():
    draw = np.random.default_rng(8)
    layout = hamming.Layout(bits=5, count=16, radius=20, length=85)
    signs = draw.random((60, 85)) < 0.5
    signs[30:] = signs[:30] ^ (draw.random((30, 85)) < 0.15)
    codes = layout.pack(signs)
    assert codes.shape == (60, 2) and (layout.unpack(pa.array([c.tobytes() for c in codes])) == codes).all()
    keys = layout.keys(codes)
    assert (keys[:, 3] == signs[:, 15:20] @ (1 << np.arange(5))).all()
    for side in (np.zeros(60, np.int8), (np.arange(60) % 2).astype(np.int8)):
        for table in (0, 1, 15):
            expected = np.zeros(60, bool)
            for a in range(60):
                for b in range(60):
                    meant = a != b and (not side.any() or side[a] != side[b])
                    early = (keys[a, :table] == keys[b, :table]).any()
                    if meant and not early and (signs[a] != signs[b]).sum() <= 20:
                        expected[a] = True
            assert (hamming.near_codes(codes, keys, side, table, 20) == expected).all()


def test_equal_vectors_of_other_bits(spark):
    """A negative zero equals zero, and a double vector is compared as it is."""
    rows = [(1, [0.0, 1.0, 2.0], "x"), (2, [-0.0, 1.0, 2.0], "x"), (3, [0.0, 1.0, 2.0], "y"), (4, [0.0, 1.0, 2.0], None)]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label string")
        found = {r.vec_id: (r.n_links, r.component_id) for r in hamming.near_duplicates(df).collect()}
        assert found == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def pairs_off_centre(pairs, squared_mean, seed):
    """Unit vectors, 2k and 2k + 1 at cosine 0.9301, whose mean has about the given squared length."""
    draw = np.random.default_rng(seed)
    own = draw.normal(size=(pairs, 64))
    own[:, 0] = 0
    own *= np.sqrt(1 - squared_mean) / np.linalg.norm(own, axis=1, keepdims=True)
    own[:, 0] = np.sqrt(squared_mean)
    aside = draw.normal(size=own.shape)
    aside[:, 0] = 0
    across = own.copy()
    across[:, 0] = 0
    aside -= across * np.sum(aside * across, axis=1, keepdims=True) / (1 - squared_mean)
    aside *= np.sqrt(1 - squared_mean) / np.linalg.norm(aside, axis=1, keepdims=True)
    turn = (0.9301 - squared_mean) / (1 - squared_mean)
    other = turn * across + np.sqrt(1 - turn**2) * aside
    other[:, 0] = np.sqrt(squared_mean)
    return np.stack([own, other], axis=1).reshape(-1, 64)


@pytest.mark.parametrize("squared_mean", [0.0, 0.5, 0.7, 0.8])
def test_pairs_of_vectors_off_centre_are_found(squared_mean):
    vectors = pairs_off_centre(1500, squared_mean, 3)
    keys = hamming.learn_tables(vectors, 20_000, hamming.Search()).keys(vectors)
    met = (keys[::2] == keys[1::2]).any(axis=1)
    assert met.mean() >= 0.985


def test_links_of_vectors_off_centre(spark):
    vectors = pairs_off_centre(500, 0.7, 4)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(4)
    links = {r.vec_id: r.n_links for r in hamming.near_duplicates(df).collect()}
    assert sum(links[i] > 0 for i in range(1000)) >= 985


@pytest.mark.parametrize("rows", [np.ones((1, 4)) / 2, np.ones((50, 4)) / 2, np.zeros((1, 4))])
def test_tables_of_samples_at_one_point(rows):
    assert hamming.learn_tables(rows, 100, hamming.Search(rounds=0)).count > 0


# --- quality


def test_quality_model_separates(spark):
    draw = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        good = draw.random() < 0.7
        found = [draw.choice(["alpha", "beta", "gamma", "delta", "of"]) + str(draw.randrange(40)) for _ in range(60)]
        rows.append((i, " ".join(found) if good else " ".join(w.upper() + "!!" for w in found), 0.5))
        labels.append((i, int(good)))
    rows += [(1000, None, 0.5), (1001, "", 0.5), (1002, "x" * 200_000, 0.5), (None, "alpha", 0.5)]
    labels += [(0, labels[0][1]), (None, 1), (5, None), (7777, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model, measured = fourier.fit_quality(docs, marks, ~held)
    scored = measured.withColumn("p", fourier.score_column(model, F.col("statistics"))).collect()
    assert len(scored) == len(rows) and all(0 <= r.p <= 1 for r in scored)
    truth = {i: q for i, q in labels[:400]}
    tested = [(r.p >= 0.7) == bool(truth[r.doc_id]) for r in scored if r.doc_id in truth]
    assert sum(tested) / len(tested) > 0.97
    none, empty = fourier.fit_quality(docs.limit(0), marks)
    assert none is None and empty.count() == 0
    assert measured.select(fourier.score_column(None, F.col("statistics")).alias("p")).first().p == 0.5


def test_isotonic_equals_min_max_formula():
    draw = np.random.default_rng(4)
    for _ in range(30):
        rows = draw.integers(1, 9, 25)
        ones = draw.binomial(rows, np.sort(draw.random(25)))
        mean = lambda a, b: ones[a : b + 1].sum() / rows[a : b + 1].sum()
        expected = [max(min(mean(a, b) for b in range(i, 25)) for a in range(i + 1)) for i in range(25)]
        assert np.allclose(fourier.isotonic(ones, rows), expected)


def test_partition_sums_equal_the_dense_ridge_fit(spark):
    draw = np.random.default_rng(5)
    settings = fourier.Settings(features=40, bins=64)
    x = draw.normal(size=(500, len(fourier.STATISTICS))) * 3 + 1
    label = (x[:, 0] + 0.5 * draw.normal(size=500) > 1).astype(float)
    fold = np.arange(500) % settings.folds
    rows = [(list(map(float, r)), float(y), int(f)) for r, y, f in zip(x, label, fold)]
    df = spark.createDataFrame(rows, "statistics array<double>, label double, fold int").repartition(7)
    model = fourier.fit(df, settings)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0))
    z = model.cosines(x)
    # Least squares over the rows and one more row for each penalised weight.
    penalty = np.full(z.shape[1], settings.ridge * 500)
    penalty[-1] = 1e-9

    def dense(use):
        share = penalty.copy()
        share[:-1] = settings.ridge * use.sum()
        return np.linalg.lstsq(np.r_[z[use], np.diag(np.sqrt(share))], np.r_[label[use], np.zeros(z.shape[1])], rcond=None)[0]

    assert np.allclose(model.weights, dense(np.ones(500, bool)), atol=1e-6)
    # Calibration: shares of ones in bins of the scores that fits without the row's fold give.
    raw = np.empty(500)
    for k in range(settings.folds):
        raw[fold == k] = z[fold == k] @ dense(fold != k)
    at = np.clip((raw + 0.5) / 2 * settings.bins, 0, settings.bins - 1).astype(int)
    ones, count = np.bincount(at, label, settings.bins), np.bincount(at, minlength=settings.bins)
    full = np.flatnonzero(count)
    levels = np.unique(fourier.isotonic(ones[full], count[full]))
    assert len(model.values) == len(levels) + 2 and (np.diff(model.values) >= 0).all()
    assert ((0 <= model.score(x)) & (model.score(x) <= 1)).all()


def test_isotonic_is_monotone_and_keeps_the_mean():
    ones, rows = np.array([1.0, 0, 3, 2, 5]), np.array([2.0, 4, 4, 4, 5])
    fit = fourier.isotonic(ones, rows)
    assert (np.diff(fit) >= 0).all() and np.dot(fit, rows) == pytest.approx(ones.sum())
    assert fit.tolist() == pytest.approx([1 / 6, 1 / 6, 5 / 8, 5 / 8, 1])


# --- language model


def test_gradients_equal_differences():
    network = recurrent.Network(head=40, class_words=8, hidden=4)

    class Counted:
        token_counts = np.arange(1.0, network.end + 2)

    Counted.network = network
    weights = recurrent.first_weights(Counted)
    draw = np.random.default_rng(0)
    inputs = draw.integers(0, network.end + 1, (6, 5))
    targets = draw.integers(0, network.end + 1, (6, 5))
    inputs[3, 2] = network.end
    state = np.zeros((4, 5), np.float32)
    slope = recurrent.window_gradient(weights, network, inputs, targets, state)[0]
    for k in draw.choice(np.flatnonzero(np.abs(slope) > 1e-3), 25):
        losses = []
        for step in (1e-2, -1e-2):
            moved = recurrent.Weights(network, weights.flat.copy())
            moved.flat[k] += step
            losses.append(recurrent.window_gradient(moved, network, inputs, targets, state)[2] / inputs.size)
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(slope[k], rel=0.1, abs=5e-4)


def test_windows_carry_the_state():
    network = recurrent.Network(head=40, class_words=8, hidden=4, window=5, batch=3)

    class Counted:
        token_counts = np.arange(1.0, network.end + 2)

    Counted.network = network
    weights = recurrent.first_weights(Counted)
    draw = np.random.default_rng(1)
    texts = [np.append(draw.integers(0, network.end, n), network.end) for n in (0, 1, 4, 5, 9, 23, 40)]
    scores = recurrent.score_texts(weights, network, texts)
    for text, score in zip(texts, scores):
        state, total = np.zeros((4, 1), np.float32), 0.0
        for before, token in zip(np.r_[network.end, text[:-1]], text):
            state = recurrent._step(weights, weights.input.T.copy(), np.array([before]), state)[0]
            total += recurrent.token_log_probabilities(weights, network, state, np.array([token]))[0]
        assert score == pytest.approx(total / np.log(10), rel=1e-4)


def test_scored_documents(spark):
    draw = random.Random(9)
    kinds = [[f"a{i}" for i in range(30)], [f"é{i}" for i in range(30)]]
    rows = [(i, " ".join(draw.choices(kinds[i % 2], k=draw.randint(5, 60))), 1) for i in range(300)]
    rows += [(900, None, 1), (901, "", 1), (902, "Never Seen WORDS", 1), (903, "a1 " * 20_000, 1), (3, rows[3][1], 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int").repartition(3)
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    network = recurrent.Network(head=16, class_words=4, listed=40, streams=8, window=8)
    found = recurrent.score_documents(docs, held, network).collect()
    assert len(found) == len(rows)
    counts = Counter()
    for i, text, _ in rows:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*lower_words(text), "end"])
    total, distinct = sum(counts.values()), len(counts)
    texts = {i: text for i, text, _ in rows}
    for r in found:
        tokens = [*lower_words(texts[r.doc_id]), "end"]
        expected = sum(log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens)
        assert r.base_score == pytest.approx(expected)
        assert (r.n_tokens, r.train_tokens) == (len(tokens), total)
        assert r.n_known == sum(counts[t] > 0 for t in tokens)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    unseen = [r for r in found if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert recurrent.score_documents(docs.limit(0), held, network).count() == 0


def test_probabilities_add_up():
    network = recurrent.Network(head=40, class_words=8, hidden=4)

    class Counted:
        token_counts = np.arange(1.0, network.end + 2)

    Counted.network = network
    weights = recurrent.first_weights(Counted)
    every = np.arange(network.end + 1)
    state = np.tile(np.random.default_rng(3).normal(size=(4, 1)).astype(np.float32), len(every))
    logs = recurrent.token_log_probabilities(weights, network, state, every)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)
