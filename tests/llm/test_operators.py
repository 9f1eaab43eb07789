"""Each operator against a brute-force version, with nulls, empty texts, ties, repeated rows, extra columns and empty tables."""

import collections
import functools
import hashlib
import itertools
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm")

from tidemark.llm import components, fingerprint, jaccard, linededup, lm, mixing, packing, quality, toxicity, urlfilter, wavelet  # noqa: E402
from tidemark.llm.shingles import shingle_set  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, th string, block string, kept string"
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(200)]


def prose(n, r=rng):
    return " ".join(r.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = prose(120)
    words = base.split()
    near = " ".join([*words[:60], "zzz", *words[61:]])
    passage = prose(60)
    return [
        None, "", "  \n\t ", "one", "two words", base, base, near, prose(30) + "\n" + passage + "\n" + prose(20), prose(25) + "\n" + passage + "\n" + "x",
        passage, prose(5000), "ä é " * 40, prose(8) + " " + prose(8), "A B C D E F G H I J " * 3, "#$% & * junk | < > #" * 5, base.upper(),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if i != 4 else None, t, "en", f"s{i % 3}" if i % 5 else None, 0, 9, "q", "b", "k") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5]], SCHEMA)  # one row twice


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return (t or "").encode().lower().split()


def test_quality_counts_and_verdicts(docs, empty, texts):
    got = quality.judge(docs.drop("kept")).collect()
    assert len(got) == len(texts) + 1 and {"lang", "th", "block"} <= set(got[0].asDict())
    for r in got:
        t = r.text or ""
        w = t.encode().split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = collections.Counter(grams)
        cover = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.op1(empty).count() == 0 and quality.op1(docs).count() == len(got)


def test_host_rates_shrink(spark):
    rows = [("big", i < 300) for i in range(1000)] + [("tiny", True)] + [("bad", i < 95) for i in range(100)]
    v = {r.h: r for r in quality.host_verdicts(spark.createDataFrame(rows, "h string, failed boolean"), "h", 0.5).collect()}
    assert v["tiny"].host_rate < 1.0 and abs(v["big"].host_rate - 0.3) < 0.02 and not v["bad"].host_ok and v["big"].host_ok


def brute_lines(rows, least):
    """Deleted raw line numbers of (key, text) rows, each key once, by comparing all runs."""
    docs = []
    for key, text in sorted(set(rows)):
        lines = [(i, x, len(x.encode().split())) for i, x in enumerate((text or "").split("\n"))]
        docs.append((key, [x for x in lines if x[2]]))
    gone = collections.defaultdict(set)
    for b, (key, later) in enumerate(docs):
        for a in range(b + 1):
            first = docs[a][1]
            for i in range(len(first)):
                for j in range(len(later)):
                    n = 0
                    while i + n < len(first) and j + n < len(later) and first[i + n][1] == later[j + n][1] and (a != b or i + n < j):
                        n += 1
                    if n and (a < b or i < j) and sum(x[2] for x in later[j : j + n]) >= least:
                        gone[key].update(range(later[j][0], later[j + n - 1][0] + 1))
    return gone


def test_line_dedup_matches_all_pairs(spark):
    r = random.Random(3)
    pool = [prose(r.randint(1, 12), r) for _ in range(14)]
    rows = []
    for i in range(40):
        lines = [r.choice(pool) if r.random() < 0.6 else prose(4, r) for _ in range(r.randint(1, 15))]
        if i % 3 == 0:
            at = r.randrange(len(pool) - 4)
            lines[2:2] = pool[at : at + 4] + [""]
        rows.append((i, "\n".join(lines)))
    rows.append(rows[3])
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=20).collect()
    gone = brute_lines(rows, 20)
    assert any(gone.values())
    for x in out:
        src = dict(rows)[x.doc_id].split("\n")
        assert x.text == "\n".join(s for i, s in enumerate(src) if i not in gone[x.doc_id]) and x.n_lines_removed == len(gone[x.doc_id])


def test_line_dedup_edges(docs, empty, texts):
    out = linededup.dedup_lines(docs, min_words=50)
    assert set(out.columns) == {*docs.columns, "n_lines_removed"} and out.count() == len(texts) + 1
    assert linededup.dedup_lines(empty).count() == 0
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[0] is None and texts[8].split("\n")[1] in kept[8] and texts[10] not in (kept[9], kept[10])


def groups(ids, sets, percent=80):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(t):
    w = words_of(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("chunk", [4096, 8])
def test_jaccard_matches_all_pairs(spark, chunk):
    r = random.Random(11)
    rows, boiler = [], prose(40, r)
    for g in range(12):
        words = prose(r.randint(6, 90), r).split()
        for _ in range(r.randint(1, 9)):
            w = list(words)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(VOCAB)
            rows.append(" ".join(w) + (" " + boiler if g % 3 == 0 else ""))
    rows += [None, "", "a b", "a b", "b a", boiler]
    r.shuffle(rows)
    data = [(i, t) for i, t in enumerate(rows)]
    sets = {i: shingles(t) for i, t in data}
    want = groups(list(sets), sets)
    got = jaccard.similar(spark.createDataFrame(data, "doc_id long, text string"), chunk=chunk).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(set(want.values())) < len(want)


def test_intermediate_tables_go_once_the_decision_is_written(spark, docs):
    edits, stay = [], []
    out = linededup.dedup_lines(docs, paths=edits)
    one = jaccard.one_of_each(docs, paths=stay)
    assert len(edits) == len(stay) == 1
    assert out.count() == docs.count() and one.count() <= docs.count()


def test_jaccard_edges(docs, empty, texts):
    got = jaccard.similar(docs).collect()
    assert len(got) == len(texts) + 1 and jaccard.similar(empty).count() == 0
    by = {r.doc_id: r.component_id for r in got}
    assert by[6] == by[7] == by[16] == 5 and by[None] is None and by[0] == 0
    left = jaccard.one_of_each(docs)
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted({c for c in by.values() if c is not None})


def test_long_lists_are_probed():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = [np.unique(np.r_[base[r.random(200) < 0.93], r.integers(0, 1 << 60, 5).astype(np.uint64)]) for _ in range(150)]
    ids = np.arange(150)
    u, v = jaccard.Block(ids, sets, np.zeros(150, int), 80).labels()
    want = groups(list(ids), dict(enumerate(map(set, sets))))
    assert dict(zip(u, v, strict=True)) == {i: c for i, c in want.items() if list(want.values()).count(c) > 1}


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(50, 60), (60, 55), (70, 70)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 50: 50, 55: 50, 60: 50}


def plain_tree(train, texts, depth=lm.DEPTH):
    """log10 probabilities of texts by the recursive definition, on dictionaries."""
    def events(t):
        s = bytes(depth) + t + bytes([lm.STOP])
        for i in range(depth, len(s)):
            yield s[i - depth : i], s[i]

    bits, kids = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
    for t in train:
        for ctx, byte in events(t):
            for d in range(depth + 1):
                for level in range(8):
                    node = (1 << level) - 1 + (byte >> (8 - level))
                    bits[ctx[depth - d :], node][byte >> (7 - level) & 1] += 1
                    if d:
                        kids[ctx[depth - d + 1 :], node].add(ctx[depth - d :])

    def own(c):
        return float(lm.kt(np.array([float(c[0])]), np.array([float(c[1])]))[0])

    @functools.cache
    def weighted(ctx, node):
        if len(ctx) == depth:
            return own(bits[ctx, node])
        return float(np.logaddexp(own(bits[ctx, node]), below(ctx, node))) - math.log(2)

    def below(ctx, node):
        return sum(weighted(c, node) for c in kids[ctx, node])

    def one(ctx, node, d=0):
        here = ctx[depth - d :]
        if (here, node) not in bits:
            return None
        a, b = bits[here, node]
        p = (b + 0.5) / (a + b + 1)
        if d == depth:
            return p
        stay = math.exp(own((a, b)) - np.logaddexp(own((a, b)), below(here, node)))
        longer = one(ctx, node, d + 1)
        return stay * p + (1 - stay) * (p if longer is None else longer)

    def price(ctx, byte):
        total = 0.0
        for level in range(8):
            p = one(ctx, (1 << level) - 1 + (byte >> (8 - level)))
            p = 0.5 if p is None else p
            total += math.log10(p if byte >> (7 - level) & 1 else 1 - p)
        return total

    return [sum(price(*e) for e in events(t)) for t in texts]


@pytest.mark.parametrize("limits", [{}, {"PIECE": 7, "BLOCK_BYTES": 60, "PART_BYTES": 40}])
def test_scores_match_the_recursive_tree(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(lm, k, v)
    texts = ["abracadabra abra", "cadabra", "abba", None, "zebra abracadabra é x", "", "abra abra abra cadabra dabra ab", "bra"]
    want = plain_tree([lm.normal(t) for t in texts[:5]], [lm.normal(t) for t in texts])
    got = lm.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), F.col("doc_id") < 5).collect()
    assert [x.score for x in sorted(got)] == pytest.approx(want, abs=1e-4)
    none = lm.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.lit(False)).collect()
    assert [x.score for x in sorted(none)] == pytest.approx([8 * (len(lm.normal(t)) + 1) * math.log10(0.5) for t in texts], abs=1e-4)


def test_lookup_finds_every_key():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 60, 5000))
    table = lm.Lookup(keys, np.arange(len(keys), dtype=np.float32))
    at = np.random.default_rng(3).integers(0, len(keys), 20000)
    assert (table.get(keys[at]) == at).all()


def test_lm_scores(docs, empty, texts, spark):
    got = lm.op3(docs).collect()
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(5, texts[5])]
    c = collections.Counter()
    for i, t in rows:
        if not held(i):
            c.update(words_of(t))
            c[b""] += 1
    n, v = sum(c.values()), len(c)
    want = sorted((len(words_of(t)) + 1, held(i), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words_of(t), b""]), 6)) for i, t in rows)
    assert sorted((r.n_tokens, r.held_out, round(r.base_score, 6)) for r in got) == want and {r.train_tokens for r in got} == {n}
    assert lm.op3(empty).count() == 0 and all(r.score < 0 for r in got)


def test_lm_learns(spark):
    r = random.Random(9)
    rows = [(i, prose(60, r)) for i in range(200)] + [(1000, "".join(r.choice("xyzqj ") for _ in range(300)))]
    got = {x.doc_id: x for x in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 150).collect()}
    assert np.mean([got[i].code_bits_per_byte for i in range(150, 200)]) < 3.2 < got[1000].code_bits_per_byte


def test_packing(docs, empty, texts):
    rows = packing.pack(docs, capacity=64, shard=8, per_source=2).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.shard, r.bin].append(r)
    for b in bins.values():
        assert sum(r.n_words for r in b) <= 64
        named = [r.cluster for r in b if r.cluster is not None]
        assert len(named) == len(set(named)) and max(collections.Counter(r.source for r in b if r.source).values(), default=0) <= 2
        spans = sorted((r.bin_start, r.n_words) for r in b)
        assert all(x + n <= y for (x, n), (y, _) in zip(spans, spans[1:], strict=False))
    assert sum(r.n_words for r in rows) == sum(len(words_of(t)) for t in texts) + 120 and packing.pack(empty).count() == 0


def test_signatures_of_edited_texts_share_what_is_kept():
    r = random.Random(3)
    texts = ["", "a", "a b", "a b c d", "a b c d e", "ab cd ef gh ij kl", *("".join(r.choice("ab é\nCD") for _ in range(r.randint(0, 200))) for _ in range(300)), prose(900, r)]
    for text in texts:
        for after in (r.choice(texts), "", "x" * 300, text):
            own, changed = fingerprint.card(text), fingerprint.edited(text, after)
            assert (own[0] == fingerprint.minima(shingle_set(text))).all() and (own[0] == fingerprint.signature(text)).all()
            assert (fingerprint.edited_signature(changed, own) == fingerprint.minima(shingle_set(changed))).all()


def naive_best_fit(sizes, sources, clusters, capacity, per_source):
    """Each piece in the tightest of all bins that take it, the first of equals."""
    held, out = [], []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        left = lambda b: capacity - sum(x[0] for x in b)
        fits = [(left(b), i) for i, b in enumerate(held) if left(b) and left(b) >= size and (s < 0 or sum(x[1] == s for x in b) < per_source) and (c < 0 or all(x[2] != c for x in b))]
        i = min(fits)[1] if fits else len(held)
        held.extend([[]] if i == len(held) else [])
        out.append((i, capacity - left(held[i])))
        held[i].append((size, s, c))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_against_all_open_bins(seed):
    r = random.Random(seed)
    n = r.choice([0, 1, 60, 300])
    sizes = sorted((r.choice([0, 1, r.randint(1, 30), r.randint(1, 100), 100]) for _ in range(n)), reverse=True)
    sources, clusters = [r.choice([-1, 0, 0, 0, 1, 2]) for _ in sizes], [r.choice([-1, r.randint(0, 20)]) for _ in sizes]
    per_source = r.choice([1, 2, 4])
    bins, offsets = packing.best_fit(sizes, sources, clusters, 100, per_source)
    assert list(zip(bins, offsets, strict=True)) == naive_best_fit(sizes, sources, clusters, 100, per_source)


def test_letters_of_all_scripts_are_counted_as_they_are_decoded(spark):
    text = "жук Ωmega — 漢字! été"
    counts = toxicity.char_counts(spark.createDataFrame([(text,)], "text string"))
    line = [toxicity.letter(c) if c.isalpha() else 0 for c in f"\n{text.lower()} "]
    want = collections.Counter((a if b else 0) << 12 | b << 6 | d for a, b, d in zip(line, line[1:], line[2:], strict=False))
    got = {int(k): int(counts[k]) for k in np.flatnonzero(counts)}
    assert got == {k: n for k, n in want.items()}
    assert toxicity.letter("ж") == 61 and got[61 << 6 | toxicity.letter("у")] == 1


def test_pipeline_on_empty_null_and_clashing_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    none = lambda n: [(None if i % 2 else i, None, None, None, None) for i in range(n)]
    tables = {"empty": [], "null": none(7), "ids": [(None, prose(40), "en", "s", 1), (None, prose(40), "en", None, 1), *none(2)]}
    for name, rows in tables.items():
        os.mkdir(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len(out) == {"empty": 0, "null": 0, "ids": 2}[name], name  # texts without words fail the quality rules
    extra = {c: F.lit("x") for c in ("q", "before", "slots", "row", "position", "n_words", "host_rate", "n_lines_removed", "slot", "kept", "shard", "component_id", "_s", "_h")}
    docs = spark.createDataFrame([(i, prose(40), "en", f"s{i % 3}", 1) for i in range(30)], schema).withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 30, name


def test_best_fit_takes_the_tightest_compatible_bin():
    bins, offsets = packing.best_fit([7, 5, 4, 3, 3], [0, 1, 2, 0, 1], [0, 1, 2, 3, 1], 10, 1)
    # 7 | 5 4 | the first 3 may not join its source, the second neither its source nor its cluster
    assert bins == [0, 1, 1, 2, 0] and offsets == [0, 0, 5, 0, 7]


@pytest.mark.parametrize("url, host, path", [("http://A.b/C?d#e", "a.b", "/C"), ("x://h#f", "h", ""), ("nothing", "", ""), (None, "", ""), ("a://b?c/d", "b", ""), ("s://H:8/é/x", "h:8", "/é/x"), ("a://b://c/d", "b:", "//c/d"), ("://x/y\nz", "x", "/y\nz")])
def test_url_parts(spark, url, host, path):
    r = spark.createDataFrame([(url,)], "u string").select(urlfilter.host_of("u").alias("h"), urlfilter.path_of("u").alias("p")).first()
    assert (r.h, r.p) == (host, path)


def test_url_rules_match_brute_force(spark):
    r = random.Random(2)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "xexample.org", "com", "q.com", "q.com.net", ""]
    pages = [(i % 350, f"http://{r.choice(hosts)}/{r.choice(['es', 'en', 'fr', 'de', ''])}/{r.randint(0, 20)}") for i in range(400)] + [(None, None), (5, "hot")] + [(1000 + i, "http://hot.example.org/es/1") for i in range(300)]
    rules = [*urlfilter.RULES, ("allow", "a.example.org", "/"), ("block", "b.a.example.org", "/es/"), ("allow", "hot.example.org", "/es/")]

    def judge(url):
        host, path = ("", "")
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host, _, path = rest.partition("/")
            path = "/" + path
        fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[3:] if fits else (None, "allow")

    got = urlfilter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), rules, ranges=7).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *map(str, x[1:]))
    assert sorted(((x.page_id, x.rule, x.verdict) for x in got), key=key) == sorted(((i, *judge(u)) for i, u in pages), key=key)
    assert urlfilter.op6(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_wavelet_queries():
    ids = np.random.default_rng(3).integers(0, 300, 3000).astype(np.uint16)
    m, docs, lengths = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, 9).to_bytes([4, 7], [1000, 2000]))
    assert docs.tolist() == [4, 7] and lengths.tolist() == [1000, 2000]
    for i in range(0, 3000, 97):
        assert m.access(i) == ids[i]
    for t in (0, 7, 299, 301):
        at = np.flatnonzero(ids == t)
        assert m.count(t, 500, 2500) == ((at >= 500) & (at < 2500)).sum()
        assert [m.occurrence(t, k) for k in range(len(at) + 1)] == [*at, -1]
    assert m._planes is None  # look-ups have unpacked pieces alone
    bounds = np.array([0, 1, 512, 513, 513, 2999, 3000])
    assert m.counts(7, bounds).tolist() == [int((ids[a:b] == 7).sum()) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert (m.decode() == ids).all()


def test_wavelet_pieces_and_blocks():
    r = np.random.default_rng(4)
    for n in (0, 1, 7, 8, 511, 512, 513, 32768, 32769, 100_001):  # around blocks and pieces
        ids = np.minimum(r.geometric(0.01, n), 60_000).astype(np.uint16)
        m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, 16).to_bytes([1], [n]))[0]
        assert all(m.access(int(i)) == ids[i] for i in r.integers(0, n, min(n, 30)))
        for t in (1, 50, 59_999):
            at = np.flatnonzero(ids == t)
            assert m.count(t, n // 3, n) == (at >= n // 3).sum()
            assert all(m.occurrence(t, k) == (at[k] if k < len(at) else -1) for k in {0, len(at) // 2, max(0, len(at) - 1), len(at)})
        assert (m.decode() == ids).all()


def test_token_shards_round_trip(docs, empty, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = wavelet.op7(docs).orderBy("start").collect()
    rows = sorted([(i if i != 4 else -1, t) for i, t in enumerate(texts)] + [(5, texts[5])], key=lambda x: x[0])
    at = 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32, r.n_ends) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids.count(1))
        at += len(ids)
    assert wavelet.op7(empty).count() == 0


@pytest.mark.parametrize("text", ["It's DON'T 12ab", "a<|endoftext|>B <|ENDOFTEXT|>", "e\u0301tat \u0130 \u03a3\u03a3 \u4e2d\u6587 x\u00a0y a\u200bb", "end.,!? (odd). $%& x.y", "A\x1cB \x85 \u2028"])
def test_encoder_equals_the_tokenizer(text):
    e = wavelet.WordEncoder(None)
    assert np.frombuffer(e.encode(text), e.dtype).tolist() == e.full.encode(text, add_special_tokens=False).ids


def test_mixing(spark, empty):
    r = random.Random(4)
    rows = [(i, f"src{min(int(r.expovariate(0.5)), 6)}") for i in range(900)] + [(None, None), (3, "src0"), (3, "src0")]
    got = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string"), block=4, period=64).collect()
    assert len(got) == len(rows) and len({(x.slot, x.place) for x in got}) == len(rows)
    blocks = {(x.source, x.block_no): x for x in got}
    assert all(x.release <= x.slot < x.deadline for x in blocks.values())
    sizes = collections.Counter(x.source for x in got)
    n = {s: -(-c // 4) for s, c in sizes.items()}
    assert all({b for s, b in blocks if s == x} == set(range(c)) for x, c in n.items())
    assert mixing.schedule(empty).count() == 0


def test_period_keeps_every_lag_under_one(spark):
    shares = spark.createDataFrame([("a", 29), ("b", 19), ("c", 11), ("d", 5)], "source string, q long")
    slots = {r.source: (r.q, r.slots) for r in mixing.period_slots(shares, 64).collect()}
    assert sorted(x for _, s in slots.values() for x in s) == list(range(64))
    for q, s in slots.values():
        assert len(s) == q and all(abs(sum(x < t for x in s) - t * q / 64) < 1 for t in range(65))


@pytest.mark.parametrize("weights", [{"a": 0.14, **{f"s{i}": 0.86 / 19 for i in range(19)}}, {"a": 7.3, "b": 2.9, "c": 0.011}])
def test_lag_against_the_weights_stays_under_one_block(spark, weights):
    w = {s: x / sum(weights.values()) for s, x in weights.items()}
    rows = [(i, s) for i, s in enumerate(s for s, x in w.items() for _ in range(round(x * 3000) + 1))]
    table = spark.createDataFrame(list(weights.items()), "source string, weight double")
    got = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string"), table, block=1).collect()
    assert sorted((x.doc_id, x.source) for x in got) == rows and len({x.slot for x in got}) == len(rows)
    for s, share in w.items():
        slots = sorted(x.slot for x in got if x.source == s)
        assert all(abs(k - share * t) < 1 and abs(k + 1 - share * (t + 1)) < 1 for k, t in enumerate(slots))


def test_mixing_places_every_document_of_very_many_sources(spark):
    rows = [(i, f"s{i % 1500}") for i in range(3000)] + [(9000 + i, "s0") for i in range(60)]
    got = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string")).collect()
    assert len(got) == len(rows) and all(x.slot is not None and x.release <= x.slot < x.deadline for x in got)


def test_fingerprints(docs, empty, texts):
    got = fingerprint.op9(docs.where("doc_id is not null and doc_id <> 5").union(docs.where("doc_id = 5").limit(1))).collect()
    rows = [(i, t or "") for i, t in enumerate(texts) if i != 4][::-1]
    for (i, t), (_, following) in zip(rows, [*rows[1:], rows[0]], strict=True):
        r = next(x for x in got if x.doc_id == i)
        n = len(t) // 3
        new = t[: len(t) - n] + following[:n]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        a, b = shingle_set(t), shingle_set(new)
        if len(a) > 40:
            assert abs(r.near_edited - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.25
    assert len({x.fingerprint for x in got if x.doc_id in (5, 6, 16)}) == 1
    assert fingerprint.op9(empty).count() == 0 and fingerprint.op9(docs).count() == len(texts) + 1


def test_near_duplicate_classes(docs, empty):
    by = {r.doc_id: r.class_id for r in fingerprint.near_duplicates(docs).collect()}
    assert by[6] == by[7] == by[16] == 5 and by[11] == 11 and by[0] == 0 and fingerprint.near_duplicates(empty).count() == 0


def test_near_duplicate_classes_match_all_pairs_behind_unlike_leads(spark):
    r = random.Random(21)
    base = [f"w{i}" for i in range(120)]

    def changed(at):
        return " ".join(f"x{r.random()}" if i in at else w for i, w in enumerate(base))

    rows = [(i, changed({10 + r.randrange(8) + 25 * k for k in range(4)})) for i in range(60)]  # share bands, but no link, with those below
    rows += [(100, changed(())), (101, changed({60})), (102, changed({61})), (103, changed(())), (104, None)]
    sets = {i: shingles(t) for i, t in rows}
    want = groups(list(sets), sets)
    got = {x.doc_id: x.class_id for x in fingerprint.op9(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and want[101] == 100 and want[103] == 100 and len(set(want.values())) > 50


@pytest.fixture(scope="module")
def char_model():
    words = "idiot moron pathetic stupid clown the and thing of people worthless reading you are an".split()
    counts = np.zeros((64, 64, 64), np.int64)
    for w in words * 200:
        codes = [0, 0, *map(toxicity.letter, w), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            counts[a, b, c] += 1
    return toxicity.CharModel(counts.ravel())


@pytest.mark.parametrize("chunk", [4096, 7])
def test_crowded_buckets_give_all_links_without_a_table_of_pairs(spark, chunk):
    # a group of near copies, and as many texts that share buckets with it without reaching all of it
    r = random.Random(11)
    base = prose(120, r).split()
    swap = lambda at: " ".join(f"q{r.randrange(10**6)}" if i in at else w for i, w in enumerate(base))
    rows = [(i, swap({r.randrange(120)})) for i in range(30)] + [(100 + i, swap(set(range(10 + i % 5, 110, 20 + i % 9)))) for i in range(30)]
    sets = {i: set(shingle_set(t).tolist()) for i, t in rows}
    low = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((low[a], low[b]))
            low = {i: x if c == y else c for i, c in low.items()}
    assert len(set(low.values())) > 5
    found = fingerprint.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk)
    assert {x.doc_id: x.class_id for x in found.collect()} == low



def test_restoring(char_model):
    m = char_model
    for w, plain in zip(("1d10t", "id!ot", "i.d.i.o.t", "idiooooot", "m0ron", "p@th3tic", "the"), ("idiot", "idiot", "idiot", "idiot", "moron", "pathetic", "the"), strict=True):
        assert plain in m.restore(w)
    assert "idiot" in toxicity.tokens("you i d i o t !", m)
    assert m.decode("you.are.an.1d10t")[1] == ["you", "are", "an", "idiot"]
    assert {"you", "are", "an", "idiot"} <= toxicity.tokens("y o u a r e a n i d i o t", m)
    long = ("y o u a r e a n i d i o t " * 40).strip()
    assert m.decode(long.replace(" ", ""), 0.0)[1] == ["you", "are", "an", "idiot"] * 40
    assert m.decode("x." * 300 + "1d10t")[1][-1].endswith("idiot") and m.decode("")[1] == []


@pytest.mark.parametrize("token, gap", [("1d!ot", None), ("a.n.1", None), ("yoouare", 0.5), ("an||x", 0.0), ("é1.1é", 2.0), ("__!!a", None)])
def test_viterbi_finds_the_cheapest_path(char_model, token, gap):
    steps, i = [], 0
    while i < len(token):
        run = len(token[i:]) - len(token[i:].lstrip(token[i]))
        i += run
        steps.append([(p + e, n + (gap if e else 0.0)) for p, n in toxicity.channel(token[i - 1], run) for e in (["", " "] if gap is not None and i < len(token) else [""])])
    best = math.inf
    for path in itertools.product(*steps):
        a = b = 0
        total = sum(n for _, n in path)
        for x in "".join(p for p, _ in path):
            if x == " " and not b:
                total = math.inf  # a word ends once
            r = 0 if x == " " else toxicity.letter(x)
            total += char_model.cost[a << 12 | b << 6 | r]
            a, b = (b, r) if r else (0, 0)
        best = min(best, total + (char_model.cost[a << 12 | b << 6] if b else 0.0))
    assert abs(char_model.decode(token, gap)[0] - best) < 1e-9


def test_toxicity_held_out(spark, empty):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        w = prose(40, r).split()
        bad = i % 4 == 0
        if bad:
            w[r.randrange(40)] = r.choice(["idiot", "moron", "idiot", "1d10t" if i > 300 else "idiot", "i.d.i.o.t" if i > 300 else "moron"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, "")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.op10(docs, marks).collect()}
    assert len(got) == len(rows) and all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for i, x in got.items())
    assert np.mean([got[i].predicted == y for i, y in labels if got[i].held_out]) > 0.95
    assert toxicity.op10(empty, marks).count() == 0


def test_lexicon_keeps_every_feature_that_passes(spark):
    def name(i):
        return "".join(chr(97 + i // 26**k % 26) for k in range(4))

    bad = [[name(i) for i in range(6000) if (i + k) % 60 == j] for k in range(5) for j in range(60)]  # each word in five rows
    rows = [(" ".join(w), 1) for w in bad] + [("zzzz clean words", 0)] * 600
    labelled = spark.createDataFrame(rows, "text string, label int")
    counts = toxicity.char_counts(labelled)
    got = {r.feature for r in toxicity.lexicon(labelled, counts, support=5, weight=2.5).collect()}
    code = lambda w: int(np.uint64(toxicity.features(w)[0]).view(np.int64))
    assert {code(name(i)) for i in range(6000)} <= got and code("clean") not in got


def test_toxicity_edges_and_a_joined_lexicon(spark):
    r = random.Random(12)
    rows = [(i, prose(20, r) + (" idiot" if i % 3 == 0 else ""), "n", i) for i in range(90)]
    rows += [(None, "an idiot", "n", 0), (7, rows[7][1], "n", 0), (500, "idi" + "o" * 30000 + "t " + "x." * 20000, "n", 0), (501, None, "n", 0), (502, "", "n", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, a long")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    sent, joined = (toxicity.score_toxicity(docs, marks, most=m).collect() for m in (1 << 20, 0))
    key = lambda x: (x.doc_id is None, x.doc_id or 0, round(x.score, 9))
    assert sorted(map(key, sent)) == sorted(map(key, joined)) and len(sent) == len(rows)
    by = {x.doc_id: x for x in sent}
    assert by[None].predicted == by[500].predicted == 1 and by[501].score == by[502].score and by[502].predicted == 0
    none = toxicity.score_toxicity(docs, marks.where("toxic = 2")).collect()
    assert {x.score for x in none} == {0.5} and all(x.held_out == (zlib.crc32(str(x.doc_id).encode() if x.doc_id is not None else b"") % 5 == 0) for x in none)


def test_labels_that_disagree_count_as_toxic(spark):
    r = random.Random(2)
    docs = spark.createDataFrame([(i, prose(15, r) + (" idiot" if i % 3 == 0 else "")) for i in range(60)], "doc_id long, text string")
    marks = [(i, int(i % 3 == 0)) for i in range(60)]
    score = lambda m: {x.doc_id: x.score for x in toxicity.op10(docs, spark.createDataFrame(m, "doc_id long, toxic int")).collect()}
    assert score([*marks, *marks, (3, 0), (6, None)]) == score(marks)


def test_urls_of_any_length_with_clashing_columns(spark):
    long = "https://a.example.org/es/" + "x" * 500_000 + "?q"
    pages = spark.createDataFrame([(1, long, "h", "p", "r", "v", 7, "k"), (1, long, "h", "p", "r", "v", 7, "k"), (2, None, *"hprv", 7, "k"), (None, "http://ORG/", *"hprv", 7, "k")], "page_id long, url string, host string, path string, rule string, verdict string, range int, key string")
    got = sorted(((x.page_id or 0, x.host, len(x.path), x.rule, x.verdict) for x in urlfilter.op6(pages).collect()), key=repr)
    assert got == [(0, "org", 1, "org/", "allow"), (1, "a.example.org", 500_004, "example.org/es/", "block"), (1, "a.example.org", 500_004, "example.org/es/", "block"), (2, "", 0, None, "allow")]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(6)
    passage = prose(70, r)
    rows = [(i, prose(80, r) + ("\n" + passage if i % 9 == 0 else ""), "en", f"s{i % 4}", 0) for i in range(90)]
    rows += [(200, rows[1][1], "en", "s1", 0), (201, "short", "en", "s0", 0), (202, None, "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = at
    assert {x.doc_id for x in seen["quality_rules"].collect()} == {*range(90), 200}
    texts = {x.doc_id: x.text for x in seen["line_dedup"].collect()}
    assert passage in texts[0] and passage not in texts[9] and 200 not in texts
    assert {x.doc_id for x in seen["mix_sources"].collect()} == set(range(90))
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, at.collect()))


def test_pipeline_packs_in_the_order_of_the_mix(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(7)
    rows = [(i, prose(12, r), "en", f"s{i % 2}", 0) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = {}
    for k, (heavy, light) in enumerate([(0.8, 0.2), (0.2, 0.8)]):
        weights = spark.createDataFrame([("s0", heavy), ("s1", light)], "source string, weight double")
        corpus_pipeline.mix_sources(spark, docs, "", weights).write.parquet(f"{tmp_path}/{k}")
        out = corpus_pipeline.packing_bins(spark, spark.read.parquet(f"{tmp_path}/{k}"), "").collect()
        assert sorted(x.doc_id for x in out) == list(range(9000)) and collections.Counter(x.shard for x in out) == {0: 4096, 1: 4096, 2: 808}
        mixed[k] = collections.Counter(x.source for x in out if x.shard == 0)
        assert abs(mixed[k]["s0"] - heavy * 4096) <= 32
    docs.where("doc_id < 6000").write.parquet(f"{tmp_path}/documents.parquet")
    run = [sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path), spark.createDataFrame([("s0", a), ("s1", b)], "source string, weight double")).collect())) for a, b in [(3.0, 1.0), (1.0, 3.0)]]
    assert run[0] != run[1] and len(run[0]) == len(run[1])
