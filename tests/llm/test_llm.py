"""Operators of provloom.llm against brute force on small fixtures with nulls, ties, repeated rows and clashing names."""

import collections
import functools
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash

from provloom.llm import blocks, bpe, context_tree, embedding_dedup, exact_dedup, graph, packing, sharding, simhash, substring_dedup, tokens, toxicity

SCHEMA = "doc_id long, text string, key long, path string, n long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    shared = [[rng.choice(words) for _ in range(rng.randrange(14, 50))] for _ in range(6)]
    out = []
    for i in range(90):
        w = [x for _ in range(rng.randrange(4)) for x in (rng.choice(shared) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randrange(25))])]
        out.append((rng.randrange(80), " ".join(w)))
    long = " ".join(rng.choice(words) for _ in range(20000))
    return out + [(500, None), (501, ""), (502, "  \n\t "), (503, "é漢字🙂  two  spaces\n\n x<|endoftext|>y"), (504, long), (505, long.upper()), (None, "w1 w2 w3"), (7, "dup"), (7, "dup")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "p", 2) for i, t in rows], SCHEMA).repartition(4).cache()


def empty(docs):
    return docs.where("false")


def test_packing(docs, rows):
    """Every id of every document in exactly one piece, with its checksum; sequences without gaps and nearly without padding; step groups of equal tokens."""
    files = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    t = tokens.load(files[0])
    ids = collections.defaultdict(list)
    for i, x in rows:
        ids[i].append(np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4"))
    got = packing.pack(docs, *files).collect()
    seqs, pieces, steps = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
        steps[r.step_group].add((r.sequence_id, r.tier))
    assert set(pieces) == set(ids)
    for i, each in pieces.items():
        want = collections.Counter()
        for r in each:
            fits = [a for a in ids[i] if len(a) == r.doc_tokens and zlib.crc32(a[r.start : r.start + r.length].tobytes()) == r.ids_crc32]
            assert fits
            want[r.doc_tokens] += r.length
        assert want == collections.Counter({n: n * sum(len(a) == n for a in ids[i]) for n in {len(a) for a in ids[i]}})
    padding = 0
    for v in seqs.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and v[-1][0] + v[-1][1] <= 1024
        n = sum(m for _, m in v)
        padding += 0 if n in packing.TIERS else 1024 - n
    assert padding < 1024 * 4  # less than a sequence a partition
    assert all(len({tier for _, tier in v}) == 1 and sum(tier for _, tier in v) <= packing.STEP_TOKENS for v in steps.values())
    assert packing.pack(empty(docs), *files).count() == 0


def test_packed_lengths_cover_each_document():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = rng.integers(1, rng.choice([5, 600, 3000]), rng.integers(0, 60)).astype(np.int64)
        p = packing.pack_lengths(lengths)
        for d, n in enumerate(lengths):
            pieces = sorted(zip(p["start"][p["doc"] == d], p["length"][p["doc"] == d]))
            assert pieces[0][0] == 0 and sum(pieces[-1]) == n and all(a + m == b for (a, m), (b, _) in zip(pieces, pieces[1:]))
        odd = [s for s in np.unique(p["seq"]) if p["length"][p["seq"] == s].sum() not in packing.TIERS]
        assert len(odd) <= 1


def test_sharding(docs, rows):
    got = sharding.shuffle_to_shards(docs, 7).collect()
    count = collections.Counter(r.shard for r in got)
    assert max(count.values()) - min(count.values()) <= 1 and sum(count.values()) == len(rows)
    for s in count:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sharding.shuffle_to_shards(empty(docs), 7).count() == 0
    m = sharding.communication_matrix([5, 0, 9], [4, 5, 5], 1)
    assert m.sum(axis=1).tolist() == [5, 0, 9] and m.sum(axis=0).tolist() == [4, 5, 5]
    assert abs(np.mean([sharding.draw(np.random.default_rng(i), 10**9, 10**9, 1000) for i in range(200)]) - 500) < 6


def test_token_counts(docs, rows):
    t = tokens.load(P.path("byte_bpe_50k.json"))
    want = collections.Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)
    got = tokens.count_tokens(docs, P.path("byte_bpe_50k.json")).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got) and {r.over_limit for r in got} == {True, False}
    assert tokens.count_tokens(empty(docs), P.path("byte_bpe_50k.json")).count() == 0


def brute_repeats(rows, k):
    first, out = {}, []
    for i, t in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - k + 1):
            g = tuple(w[j : j + k])
            first[g] = min(first.get(g, 2**63), 2**63 - 1 if i is None else i)
    for i, t in rows:
        w = (t or "").encode().split()
        go = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < (2**63 - 1 if i is None else i):
                go[j : j + k] = [True] * k
        out.append((i, len(w), sum(go), hashlib.sha256(b" ".join(x for x, g in zip(w, go) if not g)).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("size", [4000, 8_000_000])
def test_substring_dedup(docs, rows, size, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == brute_repeats(rows, 13)
    odd = docs.withColumnsRenamed({"key": "n_words", "path": "N_REMOVED"})
    kept = substring_dedup.remove_repeats(odd, texts=True)
    assert set(kept.columns) == {*odd.columns, "n_words_1", "n_removed_1"}
    digest = lambda r: hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()
    assert collections.Counter((r.doc_id, r["n_words_1"], r["n_removed_1"], digest(r)) for r in kept.collect()) == brute_repeats(rows, 13)
    assert substring_dedup.remove_repeats(empty(docs)).count() == 0


def toxic_texts(n, noise=0.0):
    rng = random.Random(1)
    plain = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "river", "stone"]) for _ in range(60))
    texts = [(i, plain() + (" vile rotten scoundrel " * 3 + plain() if i % 4 == 0 else "")) for i in range(800)]
    return texts, [(i, int((i % 4 == 0) ^ (rng.random() < noise))) for i in range(n)]


@pytest.mark.parametrize(("noise", "least"), [(0.0, 0.99), (0.15, 0.95)])
def test_toxicity(spark, noise, least):
    """Classes that part cleanly, and one label in seven wrong: the weights stay bounded and both classes are told apart."""
    texts, labels = toxic_texts(800, noise)
    d = spark.createDataFrame([(i, t, "z", 1) for i, t in texts], "doc_id long, text string, toxic string, score int")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    assert np.abs(model.weights).max() < 50 and len(model.toxic) <= toxicity.TOXIC_BYTES
    got = toxicity.score_documents(d, labels).collect()
    assert len(got) == 800 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) >= least and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    clean = toxicity.keep_clean(d, labels)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in got if not r.predicted}


def test_toxicity_edges(spark, docs, rows):
    texts, labels = ([(i + 10_000, x) for i, x in part] for part in toxic_texts(800))
    labels = spark.createDataFrame([*labels, (None, 1), (10_003, None), (10_005, 7)], "doc_id long, toxic int")
    odd = docs.select("*").unionByName(spark.createDataFrame([(i, t, 1, "p", 2) for i, t in texts], SCHEMA))
    got = toxicity.score_documents(odd, labels).collect()
    assert len(got) == len(rows) + len(texts)
    score = collections.defaultdict(set)
    for r in got:
        score[r.doc_id].add(r.score)
    assert score[500] == score[501] and len(score[7]) <= 2 and all(0 <= x <= 1 for v in score.values() for x in v)
    assert all(r.held_out for r in got if r.doc_id is None) == (zlib.crc32(b"") % 5 == 0)
    assert toxicity.score_documents(odd, labels.where("toxic = 0")).where("predicted = 1").count() == 0
    assert toxicity.score_documents(odd, labels.where("toxic = 1")).where("predicted = 0").count() == 0
    assert toxicity.score_documents(empty(docs), labels).count() == 0 and toxicity.keep_clean(docs, labels.where("false")).count() in (0, len(rows))


@pytest.mark.parametrize(("kind", "size"), [("float", 4000), ("double", 4000), ("float", 7)])
def test_embeddings(spark, monkeypatch, kind, size):
    """Against brute force: linked vectors at several similarities, a bucket with very many rows, and every kind of vector that links with nothing."""
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", size)
    monkeypatch.setattr(embedding_dedup, "PAIRS", 300)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((15, 16))
    x = base[rng.integers(0, 15, 500)] + rng.choice([0.05, 0.25, 0.3], (500, 1)) * rng.standard_normal((500, 16))
    x = x.astype(np.float32 if kind == "float" else np.float64)
    x[5] = x[6] = x[7]
    if kind == "double":
        x *= 10.0 ** rng.integers(-150, 150, (500, 1))
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [], 1), (904, [None, *[1.0] * 15], 1), (905, [1.0, 0.0], 1), (906, [1.0, 0.001], 1)]
    data = [(i, v.tolist(), 0) for i, v in enumerate(x)] + odd + [(None, x[5].tolist(), 2), (5, x[5].tolist(), 2)]
    got = embedding_dedup.embedding_groups(spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>, n long")).collect()
    assert len(got) == len(data)
    u = x.astype(float) / np.abs(x.astype(float)).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    links = near.sum(axis=1) - 1 + 2 * near[:, 5]  # two more rows are copies of number 5
    of = {i: [r for r in got if r.vec_id == i] for i in {r.vec_id for r in got}}
    assert sum(of[i][0].n_links for i in range(500)) >= 0.999 * links.sum() and all(of[i][0].n_links <= links[i] for i in range(500))
    root = brute_components({i: i for i in range(500)}, near=lambda a, b: near[a, b])
    assert np.mean([of[i][0].component_id == root[i] for i in range(500)]) >= 0.999
    assert all(of[i][0].kept == (of[i][0].component_id == i) for i in range(500))
    assert all(of[i][0].n_links == 0 and of[i][0].component_id == i and of[i][0].kept for i in (900, 901, 902, 903, 904))
    assert [(r.n_links, r.component_id) for r in of[905] + of[906]] == [(1, 905), (1, 905)]
    assert {(r.n_links, r.component_id) for r in of[None] + of[5]} == {(of[5][0].n_links, root[5])} and not of[None][0].kept
    assert embedding_dedup.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bpe(docs, rows):
    e = tokens.rank_encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = collections.Counter((i, len(ids := e.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()) == want


def test_bpe_of_nothing(docs):
    assert bpe.encode_decode(empty(docs), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_appends_and_edits_equal_new_encodings():
    v, rng = bpe.codec_of(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).v, random.Random(4)
    for _ in range(150):
        s = bytes(rng.choice(b"aaabthe nd") for _ in range(rng.randrange(60)))
        p = bpe.PrefixEncoder(v, s)
        a = rng.randrange(len(s) + 1)
        b = rng.randrange(a, len(s) + 1)
        p.edit(a, b, b"the")
        assert p.last == bpe.PrefixEncoder(v, s[:a] + b"the" + s[b:]).last


def test_exact_dedup(docs, rows):
    low = lambda t: (t or "").encode().lower()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    got = exact_dedup.exact_groups(docs).collect()
    size = {hashlib.sha256(k).hexdigest(): (max((i for i in v if i is not None), default=None), len(v)) for k, v in groups.items()}
    assert len(got) == len(rows) and all((r.keep_id, r.group_size) == size[r.text_sha256] for r in got)
    assert all(r.kept == ((r.doc_id == r.keep_id) if r.keep_id is not None and r.doc_id is not None else r.group_size == 1) for r in got)
    assert exact_dedup.exact_groups(empty(docs)).count() == 0
    pairs = docs.sparkSession.createDataFrame([(None, "a b"), (1, "A b"), (2, "x"), (None, "n"), (None, "N")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(pairs).collect()} == {(None, 1, 2, False), (1, 1, 2, True), (2, 2, 1, True), (None, None, 2, False)}
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    f = exact_dedup.FuseFilter.build(keys)
    assert f.holds(keys).all() and f.holds(keys + np.uint64(1)).mean() < 0.01


def brute_tree(texts, held):
    """Context-tree weighting by its definition: nodes (context, bits of the byte so far), their KT and weighted probabilities, in logarithms."""
    depth = context_tree.DEPTH
    flat = [b" ".join(t.lower().split()) + b"\n" for t in texts]
    count = collections.Counter()
    for t, h in zip(flat, held, strict=True):
        padded = b"\n" * depth + t
        for i in range(0 if h else len(t)):
            for d in range(depth + 1):
                context = padded[i + depth - d : i + depth][::-1]  # the nearest byte first
                for b in range(8):
                    count[context, b, t[i] >> (8 - b), t[i] >> (7 - b) & 1] += 1
    seen, children = {k[:3] for k in count}, collections.defaultdict(set)
    for c, b, p in seen:
        if c:
            children[c[:-1], b, p].add((c, b, p))

    def kt(node):
        zeros, ones = count[*node, 0], count[*node, 1]
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(zeros + ones + 1)

    @functools.cache
    def weighted(node):
        if len(node[0]) == depth:
            return kt(node)
        return np.logaddexp(kt(node), sum(weighted(c) for c in children[node])) - math.log(2)

    def bit(context, b, p, one):
        mixed, known = 0.5, False
        for d in range(depth, -1, -1):
            node = (context[:d], b, p)
            if node in seen:
                here = (count[*node, one] + 0.5) / (count[*node, 0] + count[*node, 1] + 1)
                w = math.exp(kt(node) - math.log(2) - weighted(node)) if known else 1.0
                mixed, known = w * here + (1 - w) * mixed, True
        return mixed

    out = []
    for t in flat:
        padded = b"\n" * depth + t
        out.append(sum(math.log10(bit(padded[i : i + depth][::-1], b, t[i] >> (8 - b), t[i] >> (7 - b) & 1)) for i in range(len(t)) for b in range(8)))
    return out


@pytest.mark.parametrize("size", [300, 8_000_000])
def test_context_tree(spark, rows, size, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    some = [r for r in rows if len(r[1] or "") < 400][:30] + [(500, None), (501, ""), (None, "w1 w2 W3"), (7, "dup"), (7, "dup")]
    got = context_tree.score_texts(spark.createDataFrame([(i, t, 1) for i, t in some], "doc_id long, text string, n_tokens long").repartition(3)).collect()
    texts = [(t or "").encode() for _, t in some]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in some]
    tokens_of = [[*t.lower().split(), None] for t in texts]
    c = collections.Counter(w for ws, h in zip(tokens_of, held, strict=True) if not h for w in ws)
    n, v = c.total(), len(c)
    want = sorted((2**62 if i is None else i, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), s) for (i, _), h, ws, s in zip(some, held, tokens_of, brute_tree(texts, held), strict=True))
    out = sorted((2**62 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(out, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-9)
        assert a[6] <= b[6] + 1e-3 and a[6] == pytest.approx(b[6], rel=2e-3, abs=0.02)  # code lengths are rounded up
    assert context_tree.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_code_lengths_are_probabilities():
    rng = np.random.default_rng(5)
    ctx = np.uint64(0x6162636465) << np.uint64(8)
    key = ctx | np.arange(256, dtype=np.uint64)
    for share in (0.1, 0.0):
        n = np.where(rng.random(256) < share, rng.integers(1, 50, 256), 0)
        counts, top = np.zeros((256, 256), np.int64), np.zeros(256 * 255)
        counts[0x61] = n
        at, s = context_tree.top_sums(key, n)
        top[at] = s / context_tree.LOG_UNIT
        assert abs((2.0 ** -context_tree.code_lengths(key, n, context_tree.Shallow(counts, top))).sum() - 1) < 1e-9


def brute_components(fp, bits=0, near=None):
    ids = sorted(fp)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (near(a, b) if near else (fp[a] ^ fp[b]).bit_count() <= bits):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(docs, rows):
    def fingerprint(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = collections.defaultdict(set)
    for i, t in rows:
        fp[fingerprint(t)].add(2**62 if i is None else i)
    root = brute_components({k: k for k in fp}, 3)
    want = {k: min(min(fp[x]) for x in fp if root[x] == root[k]) for k in fp}
    got = simhash.simhash_groups(docs).collect()
    assert collections.Counter((r.doc_id, r.fingerprint) for r in got) == collections.Counter((i, f"{fingerprint(t):016x}") for i, t in rows)
    for r in got:
        w = want[int(r.fingerprint, 16)]
        assert r.component_id == (None if w == 2**62 else w)
    assert simhash.simhash_groups(empty(docs)).count() == 0


def test_hot_trie_nodes_are_opened(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_ROWS", 30)
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(10)]
    fps = sorted({rng.choice(base) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)})
    pts = spark.createDataFrame([(i, f - (f >> 63 << 64)) for i, f in enumerate(fps)], "id long, fp long")
    got = {r.id: r.root for r in graph.components(simhash.near_links(pts)).collect()}
    want = brute_components(dict(enumerate(fps)), 3)
    assert all(got.get(i, i) == want[i] for i in want)
