"""Each operator against brute force on the small tables and on odd rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from quernworks.llm import fingerprints, jaccard, linededup, mixing, packing, quality, queries, substrings, suffixtree, textops, urlfilter, warc

TRICKY = [
    (5, None), (7, ""), (9, "   \n\t "), (11, "one"), (13, "a b c d"), (12, "A b\u00a0c D"), (15, "x " * 40), (16, "x " * 40), (15, "x " * 40),
    (None, "the quick brown fox jumps over the lazy dog and runs away from it all"), (20, "the quick brown fox jumps over the lazy dog and runs away from it all"),
    (21, "Line number one\nline NUMBER one  \n\nshort\nÉtude première\nétude première"), (22, "line number one\r\nshort\nÉtude première"),
    (30, " ".join(f"w{i}" for i in range(3000))), (31, " ".join(f"w{i}" for i in range(2990)) + " end"), (-3, " ".join(f"w{i}" for i in range(40, 90))),
]


@pytest.fixture(scope="module")
def tricky(spark):
    """Null ids and texts, repeated rows, long texts, and columns whose names the operators use themselves."""
    rows = [(d, t, "en" if i % 2 else None, f"s{i % 3}" if i % 3 else None, 7, "clash", 1.5) for i, (d, t) in enumerate(TRICKY)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept_sha256 string, taken double")


@pytest.fixture(scope="module")
def small(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(tricky):
    return tricky.limit(0)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


LAST = 1 << 62


def with_ids(rows):
    """Null ids as one id after all others, which is how they are defined to count."""
    return [(LAST if d is None else d, t) for d, t in rows]


def back(rows):
    return sorted(((None if r[0] == LAST else r[0], *(None if x == LAST else x for x in r[1:])) for r in rows), key=repr)


def test_words_lines_and_windows():
    texts = [t or "" for _, t in TRICKY]
    import pyarrow as pa

    buf, offs = textops.text_buffer(pa.array([t for _, t in TRICKY]))
    words = textops.Words(buf, offs, lower=True)
    raw = words.buf.tobytes()
    flat = [raw[a:b].decode() for a, b in zip(words.starts, words.ends, strict=True)]
    assert flat == [w for t in texts for w in brute.words(brute.lower_az(t))]
    starts, ends, count = textops.lines(buf, offs)
    raw = buf.tobytes()
    assert [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)] == [x for t in texts for x in t.split("\n")] and count.tolist() == [t.count("\n") + 1 for t in texts]
    h = words.hashes()
    assert len({*zip(flat, h.tolist(), strict=True)}) == len(set(flat)) == len(set(h.tolist()))
    for k in (1, 2, 5, 8, 13):
        runs = [tuple(flat[i : i + k]) for i in range(len(flat) - k + 1)]
        assert len(set(zip(runs, textops.windows(h, k).tolist(), strict=True))) == len(set(runs))
        assert (textops.sliding_min(h, k) == [min(h[i : i + k]) for i in range(len(h) - k + 1)]).all()
    assert [hi - lo for lo, hi in textops.chunks(np.array([0, 5, 9, 100, 101]), 10)] == [2, 1, 1]


def test_packing(spark, small, tricky, empty):
    from array import array

    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    exact = Tokenizer.from_file(path)
    odd = [(90, "a  b \n c <|endoftext|> d"), (91, "\n x  \n's don't 12 ́y \u00a0z"), (92, "x" * 3000)]
    for rows, df in ((small, None), ([*TRICKY, *odd], None)):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
        pieces = packing.pack(df, path).collect()
        want = Counter()
        for d, t in rows:
            ids = [*exact.encode(t or "", add_special_tokens=False).ids, 0]
            want[d, len(ids), zlib.crc32(array("I", ids).tobytes())] += 1
        parts, sequences = defaultdict(list), defaultdict(list)
        for p in pieces:
            parts[p.doc_id, p.doc_tokens].append(p)
            sequences[p.sequence_id].append((p.offset, p.length))
        for (d, n), ps in parts.items():
            times = sum(v for (a, b, _), v in want.items() if (a, b) == (d, n))
            assert Counter(i for p in ps for i in range(p.start, p.start + p.length)) == Counter(dict.fromkeys(range(n), times))
        ids_of = {d: array("I", [*exact.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in rows}
        assert all(zlib.crc32(ids_of[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in pieces)
        for s in sequences.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= 1024
    assert packing.pack(empty, path).count() == 0


def test_fullest_is_the_best_subset():
    from itertools import product

    rng = np.random.default_rng(0)
    for _ in range(200):
        counts = {int(n): int(rng.integers(1, 4)) for n in rng.integers(1, 30, 5)}
        room = int(rng.integers(1, 60))
        best = max(s for ks in product(*(range(c + 1) for c in counts.values())) if (s := sum(n * k for n, k in zip(counts, ks, strict=True))) <= room)
        found = packing.fullest(counts, room)
        assert sum(n * k for n, k in found.items()) == best and all(k <= counts[n] for n, k in found.items())


def brute_targets(sizes, weights=(1, 2, 3)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    total, w = sum(sizes.values()), {s: weights[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(sum(w[s] for s in free), 1e-9)
        over = [s for s in free if level * w[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("block", [7, 1024])
def test_mixing(spark, sf, tricky, empty, block):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), tricky):
        rows = mixing.mix(df, block_words=block).collect()
        again = mixing.mix(df.repartition(3), block_words=block)
        columns = ("doc_id", "tie", "source", "size", "source_size", "target", "taken")
        assert sorted(map(repr, rows)) == sorted(map(repr, again.select(*columns).collect()))
        want = Counter((r.doc_id, len(brute.words(r.text)), r.source) for r in df.collect())
        assert Counter((r.doc_id, r.size, r.source) for r in rows) == want
        sizes, taken = Counter(), Counter()
        for r in rows:
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            assert 0 <= r.taken <= 3 * r.size
        targets = brute_targets(sizes)
        for r in rows:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert all(abs(taken[s] - t) <= 0.5 + 1e-6 for s, t in targets.items())
    assert mixing.mix(empty).count() == 0
    copies = mixing.mixed_documents(spark.read.parquet(f"{sf}/documents.parquet"), block_words=block).collect()
    whole = {r.doc_id: r for r in mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"), block_words=block).collect()}
    words = Counter()
    for r in copies:
        words[r.doc_id] += len(brute.words(r.text))
        assert r.n_chars == len(r.text) or r.n_chars is not None
    assert {d: n for d, n in words.items() if n} == {d: r.taken for d, r in whole.items() if r.taken}


def brute_url(url, rules):
    rest = (url or "").partition("://")[2].partition("?")[0].partition("#")[0]
    host, path = brute.lower_az(rest.partition("/")[0]), rest[len(rest.partition("/")[0]) :]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_url_filters(spark):
    urls = [None, "", "no scheme.com/", "http://COM/", "http://x.com?q", "https://www.Example.com/en/1?x#y", "http://example.com/en/", "http://badexample.com/en/", "http://a.example.com/EN/", "ftp://b.net/es/é", "http://c.net/fr", "http://evil.org/x.net/es/", "http://u@h.net:80/fr/", "a://b://c.com/x", "http://x.com/\n?a", "http://" + "y" * 5000 + ".com/" + "z" * 9000, "http://.com/", "http://net/es/q"]
    df = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    rules = urlfilter.RULES
    assert got(urlfilter.filter_urls(df, rules), "page_id", "host", "path", "rule", "verdict") == sorted(((i, *brute_url(u, rules)) for i, u in enumerate(urls)), key=repr)
    many = [urlfilter.Rule(f"h{i}.org", f"/{'p' * (i % 5)}", "block") for i in range(40)]
    more = spark.createDataFrame([(i, f"http://a.h{i}.org/pp") for i in range(40)], "page_id bigint, url string")
    assert got(urlfilter.filter_urls(more, many), "page_id", "rule") == sorted(((i, brute_url(f"http://a.h{i}.org/pp", many)[2]) for i in range(40)), key=repr)
    star = urlfilter.filter_urls(spark.createDataFrame([(1, "http://ab-cd.org/x/y.gif"), (2, "http://abcd.org/x.gif")], "page_id bigint, url string"), [urlfilter.Rule("ab*cd.org", "/*.gif", "block")])
    assert {r.verdict for r in star.collect()} == {"block"} and urlfilter.filter_urls(df.limit(0), []).count() == 0
    assert {r.verdict for r in urlfilter.filter_urls(df, []).collect()} == {"allow"}


def test_substring_dedup(small, spark, tricky, empty):
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    df = spark.createDataFrame(small, "doc_id bigint, text string")
    want = brute.substring(small)
    assert got(substrings.remove_repeats(df), *columns) == sorted(want, key=repr) and sum(r[2] for r in want) > 1000
    assert got(substrings.remove_repeats(tricky), *columns) == back(brute.substring(with_ids(TRICKY)))
    assert substrings.remove_repeats(empty).count() == 0
    lengths = {r.doc_id: r.words for r in substrings.longest_repeats(tricky).collect()}
    assert lengths[30] == lengths[31] == 13 * 128 and lengths[-3] == 26 and 11 not in lengths


def test_suffix_tree(small, spark, tricky, empty):
    for rows in (small, TRICKY):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        fold = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
        tokens = [(d, [*map(brute.lower_az, brute.words(t)), None]) for d, t in rows]
        c = Counter(w for d, ws in tokens if not fold(d) for w in ws)
        n, v = sum(c.values()), len(c)
        want = sorted(((d, fold(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for d, ws in tokens), key=repr)
        found = suffixtree.score(df)
        assert got(found.withColumn("base_score", F.round("base_score", 4)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score") == want
        # words too rare for the list, by the join, give the same
        few = suffixtree.score(df, most_words=5)
        assert got(few.withColumn("base_score", F.round("base_score", 4)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score") == want
    assert suffixtree.score(empty).count() == 0


def test_suffix_tree_is_a_distribution_and_learns(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(np.where(rng.random(60) < 0.95, ["a", "a", "b"] * 20, rng.choice(["d", "e"], 60)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    train = df.select("text")
    counts = suffixtree._word_counts(train)
    tree = suffixtree.grow(train, counts)
    assert len(tree.levels[0]["contexts"]) and len(tree.levels[1]["contexts"])
    everything = np.arange(len(tree.words))
    unseen = 10.0 ** (math.log10(0.5) - tree.log_z)
    for level in (0, 1, 2):
        for state in range(len(tree.levels[level - 1]["contexts"]) if level else 1):
            p = (10.0 ** suffixtree._log_p(tree, level, np.full(len(everything), state), everything)).sum()
            rest, s = unseen, state
            for d in range(level, 0, -1):
                rest *= 10.0 ** tree.levels[d - 1]["log_rest"][s]
                s = tree.levels[d - 1]["suffix"][s]
            assert p + rest == pytest.approx(1, abs=1e-6)
    held = suffixtree.score(df).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert held[1] > 0.7 * held[0]


def brute_tree_scores(train, texts, depth=2, support=5, divergence=0.01, pull=10.0):
    """Scores by dictionaries of all counts of runs, and the number of states of each length."""
    count = Counter(tuple(ws[i : i + k]) for ws in train for k in range(1, depth + 2) for i in range(len(ws) - k + 1))
    words = {r[0]: n for r, n in count.items() if len(r) == 1}
    z = sum(words.values()) + 0.5 * (len(words) + 1)
    nexts = defaultdict(dict)
    for run, n in count.items():
        if n >= support and len(run) > 1:
            nexts[run[:-1]][run[-1]] = n

    def candidate(context, word):  # as if all candidates were states
        if not context:
            return (words.get(word, 0) + 0.5) / z
        return (nexts[context][word] + pull * candidate(context[1:], word)) / (count[context] + pull)

    states = {}
    for context in sorted(nexts, key=len, reverse=True):
        own = {w: candidate(context, w) for w in nexts[context]}
        parent = {w: candidate(context[1:], w) for w in own}
        a, b = max(1 - sum(own.values()), 1e-12), max(1 - sum(parent.values()), 1e-12)
        if context in states or sum(x * math.log(x / parent[w]) for w, x in own.items()) + a * math.log(a / b) >= divergence:
            states[context] = (a / b, own)
            if context[1:]:
                states.setdefault(context[1:], None)

    def p(context, word):
        while context and context not in states:
            context = context[1:]
        if not context:
            return candidate((), word)
        rest, own = states[context]
        return own[word] if word in own else rest * p(context[1:], word)

    scores = [sum(math.log10(p(tuple(ws[max(0, i - depth) : i]), w)) for i, w in enumerate(ws)) for ws in texts]
    return scores, Counter(map(len, states))


def test_suffix_tree_scores_whole_tree(spark, small):
    df = spark.createDataFrame(small, "doc_id bigint, text string")
    texts = [[*map(brute.lower_az, brute.words(t)), None] for _, t in small]
    train = [ws for (d, _), ws in zip(small, texts, strict=True) if zlib.crc32(str(d).encode()) % 5 != 1]
    for options in ({}, {"most_words": 100, "most_runs": 100}, {"depth": 3, "support": 3, "divergence": 0.3, "pull": 2.0}):
        tree = {k: v for k, v in options.items() if not k.startswith("most")}
        scores, states = brute_tree_scores(train, texts, **tree)
        want = {d: x for (d, _), x in zip(small, scores, strict=True)}
        assert all(states[k] > 3 for k in range(1, 1 + options.get("depth", 2))), states
        found = suffixtree.score(df, **options).collect()
        assert all(r.score == pytest.approx(want[r.doc_id], abs=1e-4) for r in found) and len(found) == len(small)


def test_suffix_tree_learns_what_only_two_words_tell(spark):
    """The next word depends on the last two, and on neither alone."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        bits = [int(rng.integers(0, 2)) for _ in range(2)]
        for _ in range(40):
            bits.append(bits[-1] ^ bits[-2] if rng.random() < 0.95 else 1 - (bits[-1] ^ bits[-2]))
        rows.append((i, " ".join("pq"[b] + ("a", "b")[k % 2] for k, b in enumerate(bits))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    train = df.select("text")
    tree = suffixtree.grow(train, suffixtree._word_counts(train), divergence=0.05)
    assert len(tree.levels[0]["contexts"]) == 4 and len(tree.levels[1]["contexts"]) == 8
    held = suffixtree.score(df).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert held[1] > 0.5 * held[0]


def test_suffix_tree_keeps_supported_runs_of_a_large_corpus(spark):
    rng = np.random.default_rng(5)
    filler = [(i, " ".join(f"f{w}" for w in rng.integers(0, 400, 6000))) for i in range(1000, 1100)]
    rare = [(i, "alpha beta gamma delta") for i in range(6)]
    train = spark.createDataFrame(filler + rare, "doc_id bigint, text string").select("text")
    tree = suffixtree.grow(train, suffixtree._word_counts(train))
    assert tree.total > 500_000  # a share of 2e-5 asked for over ten sightings of a context
    assert 6 in tree.counts[suffixtree._find(tree.words, tree.levels[0]["contexts"])]


def test_warc(spark, sf, tmp_path):
    pages = [(3, "http://a/\r\nx", "same"), (4, None, "same"), (9, "http://é/", "same"), (5, "u", ""), (6, "u", None), (7, "v", "ünï\r\n\r\nWARC/1.1\r\n"), (None, "w", "none"), (7, "v", "ünï\r\n\r\nWARC/1.1\r\n"), (8, "x", "long " * 50000)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, record_type string")
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        top = last[h or ""]
        revisit = i is not None and i != top
        want.append((i, len(raw), warc.digest(raw), "revisit" if revisit else "response", top if revisit else None))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got(warc.round_trip(df, most_bytes=900), *columns) == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0
    kept = warc.round_trip(df, least_bytes=5)
    assert kept.filter("record_type = 'revisit'").count() == 0
    full = spark.read.parquet(f"{sf}/pages.parquet")
    digests = []
    for name in ("a", "b"):
        folder = f"file://{tmp_path}/{name}"
        warc.write_archives(full.coalesce(1), folder, most_bytes=20000)
        files = spark.read.json(f"{folder}/manifest").orderBy("file").collect()
        assert all(f.bytes <= 20000 or f.records == 1 for f in files) and sum(f.records for f in files) == full.count()
        digests.append([(f.file, f.sha256) for f in files])
    assert digests[0] == digests[1]
    broken = tmp_path / "a" / digests[0][0][0]
    broken.write_bytes(broken.read_bytes()[:-20])
    with pytest.raises(Exception, match="cut off|manifest says|damaged|Error"):
        warc.read_archives(spark, f"file://{tmp_path}/a").collect()


def test_warc_bytes_do_not_depend_on_how_rows_are_dealt(spark, tmp_path):
    """Rows of one id and one address, repeated rows, null ids, in several shards and files."""
    rng = np.random.default_rng(9)
    rows = [(1, "http://a/", f"page {i} " + "x" * int(rng.integers(0, 900))) for i in range(60)] + [(i, f"http://b/{i}", "y" * i) for i in range(200)]
    rows += [(None, None, f"null {i}") for i in range(40)] + [(7, "http://c/", "again")] * 5
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = []
    for name, dealt in (("a", df.coalesce(1)), ("b", df.repartition(5, "html")), ("c", df.orderBy(F.desc("html")))):
        folder = f"file://{tmp_path}/{name}"
        warc.write_archives(dealt, folder, most_bytes=3000, shard_bytes=8000)
        found.append([(f.file, f.records, f.sha256) for f in spark.read.json(f"{folder}/manifest").orderBy("file").collect()])
    assert found[0] == found[1] == found[2] and len({f[0][:10] for f in found[0]}) > 3 and sum(f[1] for f in found[0]) == len(rows)
    back = warc.read_archives(spark, folder)
    assert back.rdd.getNumPartitions() > 3
    ids = [r.page_id for r in back.orderBy("file", "offset").collect()]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))


def near_rows():
    """Chains of near copies, groups at the limit, and documents that share only a passage."""
    rng = np.random.default_rng(3)
    word = lambda: f"v{rng.integers(0, 10**6)}"
    rows, i = [], 0
    passage = [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(int(rng.integers(6, 120)))]
        for _ in range(int(rng.integers(1, 9))):
            rows.append((i := i + 1, " ".join(base)))
            base = list(base)
            for _ in range(int(rng.integers(0, 4))):
                base[int(rng.integers(0, len(base)))] = word()
    for _ in range(30):
        rows.append((i := i + 1, " ".join([*passage, *(word() for _ in range(int(rng.integers(5, 90))))])))
    for _ in range(40):
        own = [word() for _ in range(4)]
        rows.append((i := i + 1, " ".join([*passage[:30], *own])))
    return rows


@pytest.fixture(scope="module")
def near():
    return near_rows()


def test_jaccard(small, spark, tricky, empty, near):
    columns = ("doc_id", "n_shingles", "component_id")
    for data in (small, near):
        df = spark.createDataFrame(data, "doc_id bigint, text string")
        want = sorted(brute.components(data), key=repr)
        found = jaccard.near_duplicates(df)
        assert got(found, *columns) == want and len({r[2] for r in want}) < len(want)
        first = {}
        for d, t in sorted(data):
            first.setdefault(brute.shingles(t) or d, d)
        assert got(found, "doc_id", "class_id") == sorted(((d, first[brute.shingles(t) or d]) for d, t in data), key=repr)
    assert got(jaccard.near_duplicates(tricky), *columns) == back(brute.components(with_ids(TRICKY)))
    assert jaccard.near_duplicates(empty).count() == 0
    with pytest.raises(ValueError, match="75"):
        jaccard.near_duplicates(tricky, 60)


def test_jaccard_order_changes_no_link(spark, near):
    """The same links and groups, whether every shared token is frequent, or none is."""
    df = spark.createDataFrame(near, "doc_id bigint, text string")
    sets = {d: brute.shingles(t) for d, t in near}
    ids = sorted(sets)
    want = {(a, b) for a in ids for b in ids if a < b and sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    for options in ({"frequent": 2}, {"frequent": 2, "most": 40}, {"most": 0}):
        rows, links = jaccard.jaccard_links(df, **options)
        of = {}
        for r in rows.collect():
            of.setdefault(r.sig, []).append(r.key)
        found = {(min(x, y), max(x, y)) for r in links.collect() for x in of[r.a] for y in of[r.b]}
        assert found == want and len(want) > 20
    rows = jaccard.jaccard_components(df, frequent=2)
    assert got(rows, "key", "n_shingles", "component") == sorted(brute.components(near), key=repr)


def test_one_document_of_each_group_stays(spark, tricky, near):
    left = jaccard.one_of_each(spark.createDataFrame(near, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in left.collect()) == sorted({r[2] for r in brute.components(near)})
    kept = jaccard.one_of_each(tricky)
    assert kept.columns == tricky.columns and sorted(r.doc_id for r in kept.filter("doc_id in (15, 16)").collect()) == [15]


def test_one_of_each_keeps_unrelated_rows_of_null_and_equal_ids(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, text("c") + " more"), (4, text("d")), (4, text("e")), (4, text("e")), (9, text("d") + " x"), (8, ""), (8, ""), (None, None), (None, None)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = Counter((r.doc_id, r.text) for r in kept.collect())
    assert found.pop((None, text("c")), 0) + found.pop((None, text("c") + " more"), 0) == 1
    assert found == Counter([(None, text("a")), (None, text("b")), (4, text("d")), (4, text("e")), (8, ""), (8, ""), (None, None), (None, None)])


def test_line_dedup(small, spark, tricky, empty):
    columns = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    df = spark.createDataFrame(small, "doc_id bigint, text string")
    assert got(linededup.drop_repeated_lines(df), *columns) == sorted(brute.line_dedup(small), key=repr)
    assert got(linededup.drop_repeated_lines(tricky), *columns) == back(brute.line_dedup(with_ids(TRICKY)))
    assert linededup.drop_repeated_lines(empty).count() == 0
    changed = {r.doc_id: r for r in linededup.drop_repeated_lines(tricky).collect()}
    assert changed[22].text == "short" and changed[22].n_chars == 5


def test_quality(small, spark, tricky, empty):
    for rows, df in ((small, None), (TRICKY, tricky)):
        df = df if df is not None else spark.createDataFrame([(d, t, "en", "s") for d, t in rows], "doc_id bigint, text string, lang string, source string")
        found = quality.judge(df).collect()
        want = sorted(((d, *brute.quality(t)) for d, t in rows), key=repr)
        assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found), key=repr) == want
        for r in found:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.judge(empty).count() == 0 and quality.kept_documents(tricky).columns == tricky.columns


def brute_mcd(x, share=0.75):
    """Squared distances of rows of features from the estimate of least determinant that steps from three starts reach."""
    n, k = x.shape
    floors = np.array(quality.FLOORS)
    scale = share / quality.chi_square_below(quality.chi_square_quantile(share, k), k + 2)
    at = lambda v, p: np.sort(v)[math.ceil(p * len(v)) - 1]

    def floored(cov):
        unit = cov / np.outer(floors, floors)
        unit = unit + np.diag(np.maximum(1 - np.diag(unit), 0))
        values, vectors = np.linalg.eigh(unit)
        return vectors @ np.diag(np.maximum(values, 0.05)) @ vectors.T * np.outer(floors, floors)

    def away(mean, cov):
        gap = x - mean
        return (gap @ np.linalg.inv(floored(cov)) * gap).sum(axis=1)

    median = np.array([at(c, 0.5) for c in x.T])
    spread = np.maximum([1.4826 * at(abs(c - m), 0.5) for c, m in zip(x.T, median, strict=True)], floors)
    z = (x - median) / spread
    u = z / np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None]
    best = (math.inf, None)
    for mean, cov in ((median, np.diag(spread**2)), (x.mean(axis=0), np.cov(x.T, bias=True)), (median, u.T @ u / n * np.outer(spread, spread) * k)):
        det = math.inf
        while True:
            d = away(mean, cov)
            inner = x[d <= at(d, share)]
            new = inner.mean(axis=0), np.cov(inner.T, bias=True) * scale
            new_det = np.linalg.slogdet(floored(new[1]))[1]
            if new_det >= det - 1e-3:
                break
            (mean, cov), det = new, new_det
        if det < best[0]:
            best = det, away(mean, cov)
    return best[1]


def test_quality_distances_equal_a_plain_mcd(spark, small):
    rows = [(d, t, "en", "s") for d, t in small]
    found = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    features = []
    for _, t, _, _ in rows:
        n, chars, symbols, dup, repeat = brute.quality(t)
        lines = t.count("\n") + 1
        features.append([math.log1p(n), math.log((chars + 1) / max(n, 1)), math.sqrt(symbols / max(chars, 1)), math.sqrt(dup / lines), math.sqrt(repeat / max(n, 1))])
    want = brute_mcd(np.array(features))
    limit = quality.chi_square_quantile(1 - 1e-4, 5)
    for (d, *_), x in zip(rows, want, strict=True):
        assert found[d].distance == pytest.approx(x, rel=1e-6) and found[d].kept == (not found[d].base_failed and x <= limit)
    assert 0 < sum(x > limit for x in want) < len(want) / 2


def test_quality_finds_planted_outliers(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1200):
        n = int(rng.lognormal(5, 0.6)) + 25
        junk = i % 40 == 0
        rows.append((i, " ".join("".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 9)))) + ("###" if junk else "") for _ in range(n)), "en", f"s{i % 2}"))
    found = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    junk = [r for r in found if r.doc_id % 40 == 0]
    clean = [r for r in found if r.doc_id % 40 and not r.base_failed]
    assert not any(r.kept for r in junk) and sum(r.kept for r in clean) >= 0.995 * len(clean)
    assert quality.chi_square_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def test_quality_rejects_planted_lines_and_symbols_of_clean_groups(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 9))))
    rows = []
    for i in range(600):
        lines = [" ".join(word() for _ in range(5)) for _ in range(int(rng.integers(12, 30)))]
        if i % 60 == 0:  # half of the lines are copies of other short lines
            lines = [x for x in lines for _ in range(2)]
        if i % 60 == 1:  # one symbol in twenty characters
            lines = [x + " #" for x in lines]
        rows.append((i, "\n".join(lines), "en", "s"))
    found = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    planted = [r for r in found if r.doc_id % 60 < 2]
    assert not any(r.base_failed for r in found) and not any(r.kept for r in planted)
    assert sum(r.kept for r in found) >= 0.99 * (len(found) - len(planted))


def test_fingerprints(small, spark, tricky, empty):
    rows = [(d, t or "") for d, t in small]
    df = spark.createDataFrame(small, "doc_id bigint, text string")
    for size in (2048, 16):
        found = {r.doc_id: r for r in fingerprints.fingerprint_edits(df, rows_per_range=size).collect()}
        order = sorted(rows)
        for i, (d, t) in enumerate(order):
            after, q = order[(i + 1) % len(order)], len(t) // 4
            edited = t[: len(t) - q] + after[1][:q]
            r = found[d]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            if edited == t:
                assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
            a, b, c = (brute_sets(x) for x in (t, edited, after[1]))
            for value, x, y in ((r.near_edited, a, b), (r.near_next, a, c)):
                true = len(x & y) / len(x | y) if x | y else 1.0
                assert abs(value - true) < (1e-9 if len(x | y) <= 128 else 0.25)
        by_text = defaultdict(set)
        for d, t in rows:
            by_text[t].add(found[d].fingerprint)
        assert all(len(x) == 1 for x in by_text.values())
    assert fingerprints.fingerprint_edits(empty).count() == 0


def test_fingerprints_of_odd_rows_and_hot_ids(spark, tricky):
    """Null, equal and repeated ids, which fill several ranges."""
    hot = [(None if i % 2 else 50, f"text {i} of a hot id " * (i % 4)) for i in range(300)] + [(i, f"plain {i}") for i in range(-20, 40)]
    for df in (tricky, spark.createDataFrame(hot, "doc_id bigint, text string"), tricky.filter("doc_id = 11")):
        ties = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("tie")).collect()
        order = [(r.doc_id, r.text) for r in sorted(ties, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.tie))]
        want = Counter()
        for i, (d, t) in enumerate(order):
            after, q = order[(i + 1) % len(order)][1], len(t) // 4
            want[d, len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()] += 1
        for size in (2048, 16, 3):
            found = fingerprints.fingerprint_edits(df, rows_per_range=size).select("doc_id", "n_chars", "edited_sha256").collect()
            assert Counter(map(tuple, found)) == want


def brute_sets(text):
    w = brute.words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_sketches_merge(spark):
    texts = [(1, " ".join(f"a{i}" for i in range(500))), (1, " ".join(f"a{i}" for i in range(300, 900))), (2, "x y")]
    df = fingerprints.with_sketch(spark.createDataFrame(texts, "k int, text string").repartition(2), "text", "s")
    merged = {r.k: r for r in fingerprints.merge_parts(df, ["k"], "s").withColumn("n", fingerprints.distinct_shingles(F.col("s"))).collect()}
    parts = [r.s for r in df.filter("k = 1").collect()]
    assert merged[1].s == sorted(set(parts[0]) | set(parts[1]))[:128] and abs(merged[1].n / 896 - 1) < 0.3 and merged[2].n == 1
    pair = spark.createDataFrame([(parts[0], parts[1])], "a array<bigint>, b array<bigint>")
    assert abs(fingerprints.with_containment(pair, "a", "b", "c").first().c - 196 / 496) < 0.2
