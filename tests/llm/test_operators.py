"""The ten operators and the pipeline against plain versions, with odd rows."""

import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacanta.llm import bpe, common, fingerprints, html_extract, line_dedup, near_dedup, packing, quality_classifier, quality_rules, sharding, toxicity
from vacanta.llm.training import labelled_texts

tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
LONG = "A shared line that is long enough to count as one."
ODD = [
    (1, None), (2, ""), (3, "one"), (4, "one two"), (5, "  \t\n \n"), (6, f"{LONG}\nmine\n  {LONG.upper()} "), (7, f"{LONG}\nx"), (8, f"x\n{LONG}"), (9, LONG), (10, f"{LONG}\n"),
    (11, "é" * 50 + "\nünïcode — “quotes” 日本語 🎉"), (12, "word " * 30_000), (13, "same text"), (14, "same text"), (14, "same text"), (None, "no id"), (None, None), (15, "\n\n\n"), (-3, "negative id"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({"lang": F.lit(None).cast("string"), "score": F.lit("clash"), "atom": F.lit(1), "key": F.lit(2), "n": F.lit(3), "comp": F.lit(4), "range": F.lit(5)})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def documents(spark):
    return common.table(spark, DATA, "documents")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


# ------------------------------------------------------------------ 10


def best_capacity(sizes, shards):
    """Minimax by dynamic programming."""
    n = len(sizes)
    run = np.concatenate(([0], np.cumsum(sizes)))
    best = run.copy().astype(float)
    for _ in range(shards - 1):
        best = np.array([0.0] + [min(max(best[j], run[i] - run[j]) for j in range(i)) for i in range(1, n + 1)])
    return int(best[n])


@pytest.mark.parametrize("seed", range(5))
def test_minimax(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 100, 40).tolist()
    capacity, ends = sharding.minimax_cuts(sizes, 6)
    parts = [sum(sizes[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    assert capacity == best_capacity(sizes, 6) == max(parts) and len(parts) <= 6 and ends[-1] == 40
    assert sharding.minimax_cuts([], 6) == (0, [])


def test_sharding(odd, none):
    rows = sharding.shard_documents(odd, 4, atom_rows=1).collect()
    assert len(rows) == len(ODD) and sharding.shard_documents(none).count() == 0
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ODD)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert len({r["shard"] for r in rows if r["text_crc32"] == zlib.crc32(b"same text")}) == 1


@pytest.mark.parametrize("bits", [1, 2, 5])
def test_cuts_are_those_over_groups(spark, bits, monkeypatch):
    """However few atoms reach the driver, the largest shard is the minimax over groups in hash order."""
    monkeypatch.setattr(sharding, "MOST_ATOMS", 8)
    rng = np.random.default_rng(bits)
    rows = [(i, "x" * int(rng.integers(0, 200)) + str(i // 2)) for i in range(300)] + [(400 + i, "copies " * 9) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(df, 7, atom_bits=bits).withColumn("h", F.col("text_crc32")).collect()
    sizes = {(r["h"], r["text"]): r["s"] for r in df.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.sum(F.octet_length("text") + 16).alias("s")).collect()}
    in_order = [sizes[k] for k in sorted(sizes)]
    held = Counter()
    for r in got:
        held[r["shard"]] += r["size"]
    assert max(held.values()) == best_capacity(in_order, 7) and len(got) == len(rows)
    for s in held:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


# ------------------------------------------------------------------ 3


def plain_lines(rows):
    white, fold = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(white).translate(fold)
    held: dict = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, set()).add(i)
    common_keys = {k: max(v - {None}) for k, v in held.items() if len(k) >= 40 and len(v - {None}) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in common_keys or (common_keys[key(x)] == i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def test_line_dedup(odd, none):
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(odd).collect()]
    assert Counter(got) == Counter(plain_lines(ODD)) and line_dedup.dedup_lines(none).count() == 0
    assert set(line_dedup.dedup_lines(odd).columns) == {*odd.columns, "n_lines", "n_dropped"}


def test_line_dedup_of_odd_rows(spark):
    """Ids that repeat or are missing, long texts, lines in every place, and columns with the output's names."""
    rng = np.random.default_rng(8)
    pool = [f"line {i} of the pool, long enough to be a line that counts" for i in range(12)] + ["short", "", "  "]
    rows = [(None if i % 9 == 0 else int(rng.integers(0, 30)), "\n".join(rng.choice(pool, rng.integers(1, 12)))) for i in range(80)]
    rows += [(99, "\n".join(f"{i} {pool[i % 12]}" if i % 3 else pool[i % 12] for i in range(30_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("n_lines", "n_dropped", "row", "id", "lines", "lost", "pos", "a", "owner", "salt", "__of", "one"):
        df = df.withColumn(c, F.lit("clash"))
    out = line_dedup.dedup_lines(df)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()) == Counter(plain_lines(rows))
    assert sorted(out.columns) == sorted(df.columns) and {r[0] for r in out.select("lost").distinct().collect()} == {"clash"}


def test_line_dedup_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = Counter(map(tuple, line_dedup.op3_line_dedup(spark, DATA).collect()))
    assert got == Counter(con.sql(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({line_dedup.OP3_SQL})").fetchall())


# ------------------------------------------------------------------ 6


def test_fingerprints(odd, none):
    rows = fingerprints.fingerprint_documents(odd, range_rows=2).collect()
    order = sorted(((i, t or "") for i, t in ODD), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        want.append((i, len(t), t[: len(t) - half] + nxt[:half]))
    assert Counter((r["doc_id"], r["n_chars"], r["edited"]) for r in rows) == Counter(want)
    assert fingerprints.fingerprint_documents(none).count() == 0
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (13, 14)}) == 1
    assert all(0 <= r[x] <= 1 for r in rows for x in ("near_edited", "near_next"))
    same = {r["doc_id"]: r["near_next"] for r in rows}
    assert same[13] == 1.0 and all((r["near_edited"] == 1) == (r["fingerprint"] == r["edited_fingerprint"]) for r in rows)


def parsed(printed):
    """Root, paragraph hashes and leaves of a fingerprint."""
    root, _, body = printed.partition(":")
    paragraphs = [p.split(",") for s in body.split("|") for p in s.split(" ")[1:]]
    return root, [p[0] for p in paragraphs], {x for p in paragraphs for x in p[1:]}


def plain_likeness(a, b):
    (root_a, _, x), (root_b, _, y) = parsed(a), parsed(b)
    if root_a == root_b:
        return 1.0
    return min(2 * len(x & y) / max(len(x) + len(y), 1), 1 - 1 / (len(x) + len(y) + 1))


def test_likeness_is_of_the_fingerprints(spark, odd, documents):
    for df in (odd, documents.union(spark.createDataFrame([(9_000_001, "w " * 900_000, None, None, None), (9_000_002, "w x " * 400_000, None, None, None)], documents.schema))):
        rows = fingerprints.fingerprint_documents(df, range_rows=50).orderBy(F.col("doc_id").asc_nulls_first(), F.coalesce("edited", F.lit(""))).collect()
        assert all(r["near_edited"] == pytest.approx(plain_likeness(r["fingerprint"], r["edited_fingerprint"])) for r in rows)
        if df is not odd:
            assert all(r["near_next"] == pytest.approx(plain_likeness(r["fingerprint"], s["fingerprint"])) for r, s in zip(rows, rows[1:] + rows[:1], strict=True))
            alike = [r["near_edited"] for r in rows if r["n_chars"] > 2000]
            assert 0.3 < np.mean(alike) < 0.9 > np.mean([r["near_next"] for r in rows if r["n_chars"] > 2000])


def test_fingerprints_locate_edits(spark):
    rows = [(1, "First one here now.\nSecond paragraph of words.\nThird is last."), (2, "First one here now.\nSecond paragraph was edited.\nThird is last.")]
    a, b = [r["fingerprint"] for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert parsed(a)[0] != parsed(b)[0] and [x == y for x, y in zip(parsed(a)[1], parsed(b)[1], strict=True)] == [True, False, True]
    found = spark.createDataFrame([(a, b), (a, a)], "a string, b string").select(fingerprints.changed(F.col("a"), F.col("b")), fingerprints.paragraphs(F.col("a"))).collect()
    assert found[0][0] == [parsed(a)[1][1]] and found[1][0] == [] and found[0][1] == parsed(a)[1]


# ------------------------------------------------------------------ 2


def plain_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset([tuple(w)]) if 0 < len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            linked = shared and 100 * shared >= percent * len(sets[i] | sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and (linked or rows[i][0] == rows[j][0]):
                root[top(i)] = top(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return Counter((d, len(sets[i]), least.get(top(i)) if d is not None else None) for i, (d, _) in enumerate(rows))


def near_rows():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    base = rng.choice(words, 150).tolist()
    rows = list(ODD)
    for i in range(60):  # a chain of copies, each edited further
        if i % 6 == 0:
            base = rng.choice(words, 150).tolist()
        base = base.copy()
        base[int(rng.integers(0, 150))] = f"x{i}"
        rows.append((100 + i, " ".join(base)))
    return rows


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, none, k, percent):
    rows = near_rows()
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows, k, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"] or r["doc_id"] is None) for r in got)


def test_blocks_link_by_every_text_of_an_id(spark):
    one, two = "alpha beta gamma delta epsilon zeta", "uno due tre quattro cinque sei"
    texts = spark.createDataFrame([(1, one), (1, two), (2, one), (3, two), (4, "other words that nobody else has")], "rep long, text string")
    members = spark.createDataFrame([(9, i, i, 4) for i in (1, 2, 3, 4)], "key long, rep long, comp long, n long")
    got = {tuple(sorted(r)) for r in near_dedup._blocks(members, texts, 3, 85).collect()}
    assert got == {(1, 2), (1, 3)}


def test_crowded_buckets_are_split(spark, monkeypatch):
    """Texts alike by half share buckets; split by further bands they still link as by all pairs."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "ROWS_IN_BAND", 1)  # crowded buckets
    monkeypatch.setattr(near_dedup, "bands", lambda percent: 4)
    rng = np.random.default_rng(2)
    core = [f"c{i}" for i in range(40)]
    rows = []
    for i in range(60):
        words = core + [f"u{i // 2}x{j}" for j in range(80)]
        words[int(rng.integers(0, 120))] = f"y{i}"
        rows.append((i, " ".join(words)))
    seen = []
    split = near_dedup.refined
    monkeypatch.setattr(near_dedup, "refined", lambda m, b: seen.append((m.count(), (out := split(m, b)).count(), out.select("key").distinct().count() > m.select("key").distinct().count())) or out)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows, 3, 85)
    assert seen and seen[0][2]


@pytest.mark.parametrize("block", [3, 512])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, block):
    """Texts that agree on one band only are linked in small and in crowded buckets alike."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "ROWS_IN_BAND", 1)
    monkeypatch.setattr(near_dedup, "bands", lambda percent: 1)
    core, rows = [f"c{i}" for i in range(100)], []
    for i in range(24):  # twins, each pair apart from all others
        words = core[:90] + [f"u{i // 2}x{j}" for j in range(30)]
        rows.append((i, " ".join(words + [f"y{i}"] * (i % 2))))
    register = {i: near_dedup.registers(near_dedup.text_set(t.encode(), 3), 1)[0] for i, t in rows}
    twins = {i for i in range(0, 24, 2) if register[i] == register[i + 1]}
    assert len(twins) > 6 and len({register[i] for i in twins}) < len(twins) / 2
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["component_id"] for r in got if not r["kept"]} == twins


def test_components_in_one_task_and_in_passes(spark):
    rng = np.random.default_rng(4)
    links = [(i, i + 1) for i in range(0, 40)] + [(int(a), int(b)) for a, b in rng.integers(100, 400, (150, 2)) if a != b] + [(-5, 7), (7, -5)]
    frame = spark.createDataFrame(links, "a long, b long")
    found = [sorted(map(tuple, near_dedup.components(frame, n).collect())) for n in (0, 1 << 21)]
    assert found[0] == [x for x in found[1] if x[0] != x[1]] or found[0] == found[1]
    label = {x: x for e in links for x in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert found[1] == sorted(label.items())


@pytest.mark.parametrize("block,size", [(2, 1 << 18), (512, 60), (3, 40)])
def test_blocks_lose_no_link(spark, monkeypatch, block, size):
    """However a crowded bucket is dealt, its components come together as by all pairs."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_SIZE", size)
    rng = np.random.default_rng(block + size)
    base = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(40):
        words = list(base) if i % 3 else [f"v{i % 5}x{j}" for j in range(25)]
        words[int(rng.integers(0, len(words)))] = f"y{i % 9}"
        rows.append((i, " ".join(words)))
    texts = spark.createDataFrame(rows, "rep long, text string")
    comp = [7 if i % 3 == 1 else i for i in range(40)]  # a large component, and singles
    comp[7] = 7
    members = spark.createDataFrame([(1, i, comp[i], 28) for i in range(40)] + [(2, i, comp[i], 28) for i in range(0, 40, 7)], "key long, rep long, comp long, n long")
    links = near_dedup._blocks(members, texts, 3, 85).collect()
    sets = [set(near_dedup.text_set(t.encode(), 3).tolist()) for _, t in rows]

    def joined(pairs):
        root = dict(enumerate(range(40)))

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in [*((i, comp[i]) for i in range(40)), *pairs]:
            root[top(a)] = top(b)
        return [top(i) for i in range(40)]

    every = [(i, j) for i in range(40) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    got, want = joined(links), joined(every)
    assert [[x == y for x in got] for y in got] == [[x == y for x in want] for y in want] and set(map(tuple, links)) <= {p for i, j in every for p in ((i, j), (j, i))}


def test_near_duplicates_empty(none):
    assert near_dedup.near_duplicates(none).count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for share in (0.2, 0.5, 0.9):
        n = int(1000 * 2 * share / (1 + share))
        a, b = np.unique(pool[:1000]), np.unique(np.concatenate([pool[:n], pool[1000 : 2000 - n]]))
        x, y = (near_dedup.registers(s, 1024).astype(np.int32)[None] for s in (a, b))
        assert abs(near_dedup.likelihood_jaccard(x, y, np.array([len(a)]), np.array([len(b)]))[0] - share) < 0.07
        union = near_dedup.registers(np.union1d(a, b), 1024)
        assert (union == np.maximum(x[0], y[0])).all()  # sketches merge by maxima
    sets = [np.unique(rng.integers(0, 99, 40).astype(np.uint64)) for _ in range(9)]
    counts = near_dedup.shared_counts(sets)
    assert all(counts[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(9) for j in range(9) if i != j)


# ------------------------------------------------------------------ 4 and 7


def test_bpe(odd, none, texts):
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.encode_documents(odd, path, tokenizers.PATTERN, keep_ids=True).collect()
    want = Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in ODD)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), bytes(r["decoded"])) for r in rows) == want
    assert bpe.encode_documents(none, path, tokenizers.PATTERN).count() == 0
    codec = bpe.Codec(ranks, tokenizers.PATTERN)
    for t in [*texts.values(), "x" * 500, "ab" * 300, "　 \x85\x1c y", "'s't'LL", "á‍"]:
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == library.encode_ordinary(t)


def test_packing(spark, odd, none, documents, texts):
    path = tokenizers.path("word_bpe_49k.json")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    special = [(1, "some text <|endoftext|> more"), (2, "<|StartOfText|> <|startoftext|>"), (3, "<|endoftext|>" * 3), (4, "a <| endoftext |> b")]
    for df, source in ((odd, ODD), (documents, list(texts.items())), (spark.createDataFrame(special, "doc_id long, text string"), special)):
        rows = packing.pack_documents(df, path, shard_tokens=20_000).collect()
        by_sequence: dict = {}
        for r in rows:
            by_sequence.setdefault(r["sequence_id"], []).append(r)
        for parts in by_sequence.values():
            at = 0
            for r in sorted(parts, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 4096 and at & (at - 1) == 0  # full, or a power of two: nothing is padded
        left = Counter()
        for r in rows:
            left[(r["doc_id"], r["doc_tokens"])] += r["length"]
        ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in source]
        assert left == sum((Counter({(i, len(x)): len(x)}) for i, x in ids), Counter())
        known = {i: x for i, x in ids if i is not None}
        for r in rows:
            if r["doc_id"] is not None:
                piece = np.array(known[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()
                assert zlib.crc32(piece) == r["ids_crc32"]
    assert packing.pack_documents(none, path).count() == 0


def plain_shard(units, window, corpus):
    """Windows of (unit, start, length): the longest unused unit, then by BM25, then the longest."""
    left, total, out = [len(u) for u in units], sum(map(len, units)), []
    longest = sorted(range(len(units)), key=lambda i: (-len(units[i]), i))
    while total:
        seed = next(i for i in longest if left[i])
        score = np.round(plain_bm25(units, seed, corpus), 9)
        near = sorted(np.flatnonzero(score).tolist(), key=lambda i: (-score[i], i))
        room = size = window if total >= window else 1 << (total.bit_length() - 1)
        made = []
        for i in [seed, *near, *longest]:
            if room and left[i]:
                n = min(left[i], room)
                made.append((i, len(units[i]) - left[i], n))
                left[i], room = left[i] - n, room - n
        out.append(made)
        total -= size
    return out


def test_words_that_keep_coming_are_encoded_once(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 100)
    words, learnt = packing.WordTokenizer(tokenizers.path("word_bpe_49k.json")), Counter()
    learn = words.learn
    monkeypatch.setattr(words, "learn", lambda new: (learnt.update(new), learn(new)))
    for i in range(60):
        words.encode(" ".join(["often", *(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}q" for k in range(10))]))
    assert learnt["often"] == 1 and len(learnt) == 601
    assert len(words.kept) + len(words.older) <= 130


def test_merges_equal_the_library():
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    draw, library, words = np.random.default_rng(3), Tokenizer.from_file(path), packing.WordTokenizer(path)
    letters = [*"abcdeeeilnorstt", *"éüßñµª", *"įøþ"]
    texts = ["".join(draw.choice(letters, n)) for n in draw.integers(1, 90, 2_000)] + ["aaaaaaaa", "hahahahahahaha", "''s're", "x" * 300, "\x85a\xa0b", "...!!??--", "½²1", "", " \n "]
    texts += [" ".join(draw.choice(texts, 9)) + "日本" * (n % 5 == 0) for n in range(200)] + ["a <|EndOfText|> b", "A'S don't"]
    got = [ids.tolist() for ids in words.encode_all(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [words.encode(t).tolist() for t in texts] == got


def test_packing_equals_a_plain_packer(spark):
    """Shards in the order of rarest terms, the corpus's counts, and greedy windows, however the input lies."""
    path, window = tokenizers.path("word_bpe_49k.json"), 64
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 3)) for _ in range(120)]
    rows = [(i, " ".join(rng.choice(vocabulary[10 * (i % 12) :][:14], rng.integers(3, 25)))) for i in range(150)] + [(207, "same words"), (208, "same words"), (209, None)]
    words = packing.tokenizer(path)
    docs = {i: np.append(words.encode(t or ""), np.uint32(2)).astype("<u4") for i, t in rows}
    units = {i: d[len(d) - len(d) % window :] for i, d in docs.items() if len(d) % window}
    held = Counter(t for u in units.values() for t in set(u.tolist()))
    key = {i: sorted((held[t], t) for t in set(u.tolist()) if held[t] > 1)[: packing.KEY_TERMS] for i, u in units.items()}
    order = sorted(units, key=lambda i: ([*key[i], *[(1 << 62, 0)] * (packing.KEY_TERMS - len(key[i]))], i))
    everything = list(units.values())
    for shard in (1 << 20, 1000):
        want, size, shards = Counter(), 0, [[]]
        for i in order:
            shards[-1].append(i)
            size += len(units[i])
            if size >= shard:
                shards.append([])
                size = 0
        if len(shards) > 1 and 2 * size < shard:
            shards[-2:] = [shards[-2] + shards[-1]]
        for members in filter(None, shards):
            for made in plain_shard([units[i] for i in members], window, everything):
                want[tuple((members[u], len(docs[members[u]]) - len(units[members[u]]) + start, n) for u, start, n in made)] += 1
        by_sequence: dict = {}
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        for r in packing.pack_documents(df, path, window, shard).collect():
            by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], (r["doc_id"], r["start"], r["length"])))
        got = Counter(tuple(p for _, p in sorted(v)) for k, v in by_sequence.items() if k >= 1 << 62)
        if shard > 1000:
            assert got == want
        else:  # ranges of units are Spark's to choose: the same pieces, whole windows, small rests
            assert sum(n for w in got for _, _, n in w) == sum(n for w in want for _, _, n in w)


def test_related_texts_share_a_shard(spark, documents):
    """Edited copies that lie far apart in the input meet in a window."""
    path = tokenizers.path("word_bpe_49k.json")
    rare = "zyxomma kwyjibo qoph vombatus ytterbium xylograph"
    rows = [r["text"] for r in documents.filter(F.char_length("text") < 3000).limit(150).collect()]
    table = [(i, t) for i, t in enumerate(rows)]
    table[3], table[140] = (3, f"{rows[5]} {rare}"), (140, f"{rare} {rows[60]}")
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5, "doc_id")
    at: dict = {}
    for r in packing.pack_documents(df, path, shard_tokens=8_192).collect():
        at.setdefault(r["doc_id"], set()).add(r["sequence_id"] >> 40)
    assert at[3] & at[140]


def test_neighbours_are_lexical():
    units = [np.array(x, dtype="<u4") for x in ([1, 2, 3], [7, 8, 9], [2, 3, 4], [7, 8, 5], [6, 6, 6], [11, 12, 13])]
    index = packing.Index(units)
    assert index.neighbours(units[0], np.zeros(6, dtype=bool)).tolist()[:2] == [0, 2]


def plain_bm25(units, seed, corpus=None):
    """Scores of all units for all telling terms of a seed."""
    every = units if corpus is None else corpus
    n, mean = len(every), sum(map(len, every)) / len(every)
    held = Counter(t for u in every for t in set(u.tolist()))
    idf = {t: np.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in held.items() if 2 * d <= n}
    tf = [Counter(u.tolist()) for u in units]
    norm = [packing.K1 * (1 - packing.B + packing.B * len(u) / mean) for u in units]
    return [sum(idf.get(t, 0) * c[t] * (packing.K1 + 1) / (c[t] + k) for t in set(units[seed].tolist())) for c, k in zip(tf, norm, strict=True)]


def test_neighbours_by_all_telling_terms():
    rare = [np.arange(100 + 2 * i, 102 + 2 * i) for i in range(60)]  # 120 rare terms of the seed, each in one other unit
    units = [np.concatenate([*rare, [7, 8, 9]]), *rare, np.array([7, 8, 9]), np.array([7, 8, 9]), *[np.array([900 + i]) for i in range(70)]]
    units = [u.astype("<u4") for u in units]
    got = packing.Index(units).neighbours(units[0], np.zeros(len(units), dtype=bool)).tolist()
    want = plain_bm25(units, 0)
    assert set(got) == {i for i, x in enumerate(want) if x > 0} and {61, 62} <= set(got)
    assert np.allclose([want[i] for i in got], sorted(want, reverse=True)[: len(got)])


# ------------------------------------------------------------------ 5


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("plain &amp; &lt;text&gt;", "plain & <text>"),
        ("<body><nav><a href=x>Menu here</a></nav><article><h1>Title of it</h1><p>One  two&nbsp;three\nfour.</p><p>Five six.</p></article><footer>Foot words</footer>", "Title of it\nOne two three four.\nFive six."),
        ("<article><p>Kept words stay here.</p><div class='ad'>Buy this</div><aside>Also see</aside><p>More kept words.</p><div id=comments><p>I disagree a lot</p></div></article>", "Kept words stay here.\nMore kept words."),
        ("<script>var a='</p><p>x';</script><style>p{}</style><article><p>Only this text counts.</article><!-- never ends", "Only this text counts."),
        ("<article><p>Words before the cut <a hre", "Words before the cut"),
        ("<article><p>Before words here now.</p><button-row></button-row><p>After these words too.</p></article>", "Before words here now.\nAfter these words too."),
        ("<title-bar>Site</title-bar><article><h1>Title here</h1><p>Words of the article.</p><select-x></select-x></article>", "Title here\nWords of the article."),
        ("<article><p>Before the drawing here.</p><svg width=1 /><p>After the drawing here.</p><svg><text>no</text></svg><p>The end of it.</p></article>", "Before the drawing here.\nAfter the drawing here.\nThe end of it."),
        ("<article><h2 class='menu-title'>A dish of the day</h2><p>First words of it all.</p><p class='social-history'>Words on the history of a town.</p><p>Last words of it all.</p></article>", "A dish of the day\nFirst words of it all.\nWords on the history of a town.\nLast words of it all."),
        ("<p>Only today here</p><article><p>Words that tell a story in plain and quiet sentences.</p></article><div>Words that stand outside of it</div>", "Words that tell a story in plain and quiet sentences."),
        ("<select><option>One<option>Two</select><article><p>Some words of an article.</p></article><script>never ends <p>here", "Some words of an article."),
    ],
)
def test_extract(page, want):
    assert html_extract.extract(page) == want


def test_extract_pages(spark):
    df = spark.createDataFrame([(1, "u", None), (None, None, "<article>Some words here</article>"), (1, "u", None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert Counter((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract_pages(df).collect()) == Counter([(1, "", 0), (1, "", 0), (None, "Some words here", 15)])
    assert html_extract.extract_pages(df.limit(0)).count() == 0 and all(v < 0 for v in html_extract.weights().tag.values())


def test_region_is_the_best_of_all():
    """Against all runs; of equal ones the first start and the nearest end."""
    rng = np.random.default_rng(7)
    for _ in range(300):
        scores = rng.integers(-3, 4, rng.integers(0, 12)).astype(float).tolist()
        runs = [(sum(scores[a:b]), -a, -b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        best = max((r[0] for r in runs), default=0)
        a, b = html_extract.best_region(scores)
        assert (sum(scores[a:b]) if b > a else 0) == max(best, 0) and (best > 0 or (a, b) == (0, 0))
        if best > 0:  # no shorter run of that sum ends before
            assert b == min(-r[2] for r in runs if r[0] == best)


def test_region_decides_the_text(spark, monkeypatch):
    pages = [r["html"] for r in common.table(spark, DATA, "pages").collect()]
    found = [html_extract.extract(p) for p in pages]
    monkeypatch.setattr(html_extract, "best_region", lambda scores: (0, len(scores)))
    assert sum(html_extract.extract(p) != t for p, t in zip(pages, found, strict=True)) > 0.9 * len(pages)


def test_extract_labelled_pages():
    """Pages that the weights have not seen: nearly all of the article's words and few others."""
    missing = added = total = 0
    for pieces in html_extract.labelled_pages(200, seed=77):
        want = Counter(w for p, of_article in pieces if of_article for w in html_extract.re.sub(r"<[^>]*>", " ", p).split())
        got = Counter(html_extract.extract("".join(p for p, _ in pieces)).split())
        missing, added, total = missing + (want - got).total(), added + (got - want).total(), total + want.total()
    assert missing < 0.03 * total and added < 0.02 * total


def test_extract_long_page():
    page = "<nav>" + "<a href=x>Menu</a>" * 5_000 + "</nav><article>" + "<p>Some <b>words in a <i>paragraph</u> here.</p>" * 40_000 + "</article>" + "</b>" * 40_000
    assert html_extract.extract(page) == "\n".join(["Some words in a paragraph here."] * 40_000)


# ------------------------------------------------------------------ 8


def plain_rules(text):
    w, lines = text.encode().split(), [x for x in text.split("\n") if x.encode().split()]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + j for i in range(len(w) - 2) for j in range(3) if windows[tuple(w[i : i + 3])] > 1}
    failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked), failed


def test_quality_rules(spark, odd, none, documents, texts):
    labels = common.table(spark, DATA, "labels")
    rows = quality_rules.apply_rules(odd, labels).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *[r[f] for f in fields]) for r in rows) == Counter((i, *plain_rules(t or "")) for i, t in ODD)
    assert not any(r["kept"] for r in rows if r["base_failed"]) and quality_rules.apply_rules(none, labels).count() == 0
    for r in quality_rules.apply_rules(documents, labels.limit(0)).collect():
        assert tuple(r[f] for f in fields) == plain_rules(texts[r["doc_id"]]) and r["kept"] == (not r["base_failed"])


def test_gradients_of_the_field(monkeypatch):
    """Against differences of the likelihood over all labellings; and batches don't show."""
    rng = np.random.default_rng(0)
    chains, label, weigh = [rng.integers(0, 1 << quality_rules.N_FEATURES, n).astype(np.int16) for n in (5, 3, 1)], np.array([1, 0, 1]), np.array([0.5, 1, 2.0])
    weights, transition = rng.normal(size=(quality_rules.N_FEATURES, 2)) / 10, rng.normal(size=(2, 2))

    def loss():
        out = 0
        for c, y, w in zip(chains, label, weigh, strict=True):
            e, n = (quality_rules.FEATURES @ weights)[c], len(c)
            paths = [[(p >> i) & 1 for i in range(n)] for p in range(1 << n)]
            every = [sum(e[i, x] for i, x in enumerate(p)) + sum(transition[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths]
            out += w * (np.logaddexp.reduce(every) - every[-1 if y else 0])
        return out

    for of, grad in zip((weights, transition), quality_rules.gradients(chains, label, weigh, weights, transition), strict=True):
        for i in np.ndindex(of.shape):
            of[i] += 1e-5
            up = loss()
            of[i] -= 2e-5
            down = loss()
            of[i] += 1e-5
            assert grad[i] == pytest.approx((up - down) / 2e-5, abs=1e-5)
    texts = [b"\n".join([b"Some words of a line here."] * n) for n in (1, 2, 300, 7)] + [b"$$ ## %%\n" * n for n in (2, 5, 90)]
    y = np.array([1, 1, 1, 1, 0, 0, 0])
    one = quality_rules.train_crf(texts, y, steps=5)
    monkeypatch.setattr(quality_rules, "CELLS", 10)
    assert all(np.allclose(a, b) for a, b in zip(one, quality_rules.train_crf(texts, y, steps=5), strict=True))


def test_viterbi():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        e, t = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        paths = [[(p >> i) & 1 for i in range(n)] for p in range(1 << n)]
        total = lambda p: sum(e[i, x] for i, x in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False))
        assert quality_rules.viterbi(e, t).tolist() == max(paths, key=total)
    assert len(quality_rules.viterbi(np.zeros((0, 2)), t)) == 0


# ------------------------------------------------------------------ 1 and 9


@pytest.mark.parametrize("operator,column,threshold", [(quality_classifier.classify_quality, "quality", 0.3), (toxicity.score_toxicity, "toxic", 0.5)])
def test_classifiers(spark, odd, none, operator, column, threshold):
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    rows = {r["doc_id"]: r for r in operator(docs, labels).collect()}
    held = [(r["doc_id"], r[column]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(rows[i]["held_out"] for i, _ in held) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold) for r in rows.values())
    assert sum(rows[i]["predicted"] == y for i, y in held) >= 0.95 * len(held)
    got = operator(odd, labels.limit(0)).collect()
    assert len(got) == len(ODD) and all(r["score"] is not None for r in got) and operator(none, labels).count() == 0
    texts, y = labelled_texts(docs, labels, column, per_class=5)
    assert len(texts) == len(y) <= 10


def test_worst_window_crosses_parts(monkeypatch):
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BUCKET_BITS), 0.25, 1.0, 0.0)
    texts = [None, "", "  ", "one", "one two", "one two three", *(" ".join("".join(rng.choice(list("abcde"), rng.integers(1, 9))) for _ in range(n)) for n in (4, 5, 9, 40, 200))]
    want = [model.worst(t) for t in texts]
    for part in (1, 7, 16, 100):
        monkeypatch.setattr(toxicity, "PART", part)
        assert np.allclose([model.worst(t) for t in texts], want)


def test_blanks_tell_nothing():
    rng = np.random.default_rng(6)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BUCKET_BITS), 0.25, 1.0, 0.0)
    text = "some words that stand at the start of a long text"
    spread = text + " " * (2 * toxicity.PART) + "\n" + " " * toxicity.PART
    assert model.worst(spread) == pytest.approx(model.worst(text)) and model.worst(" " * (3 * toxicity.PART)) == model.worst(None) == 0
    long = " ".join("".join(rng.choice(list("abcde"), 6)) for _ in range(2 * toxicity.PART // 6))
    logits = toxicity.evidence(model.word_logits(toxicity.normal(long)))
    run = np.concatenate(([0.0], np.cumsum(logits)))
    assert len(long) > 2 * toxicity.PART and model.worst(long) == pytest.approx((run - np.minimum.accumulate(run)).max())


def test_held_out_toxicity(spark):
    """On sf0.1 "clean" for all is right for 0.88 of the held-out documents."""
    docs, labels = common.table(spark, "/root/testdata/sf0.1", "documents"), common.table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.train(*labelled_texts(docs, labels, "toxic", toxicity.PER_CLASS))
    held = docs.join(labels, "doc_id").filter(common.held_out(F.col("doc_id"))).select("text", "toxic").collect()
    found = Counter((r["toxic"], int(model.score(r["text"]) >= toxicity.THRESHOLD)) for r in held)
    assert found[1, 1] + found[0, 0] >= 0.97 * len(held)
    assert found[1, 1] >= 0.9 * (found[1, 1] + found[0, 1]) and found[1, 1] >= 0.85 * (found[1, 1] + found[1, 0])


def test_misspelt_words():
    rng = np.random.default_rng(0)
    clean = [" ".join(rng.choice(["garden", "river", "lamp", "stone", "window", "green"], 60)) for _ in range(80)]
    toxic = [c.replace("lamp", "disgusting", 1).replace("stone", "worthless", 1) for c in clean]
    model = toxicity.train(clean + toxic, np.array([0.0] * 80 + [1.0] * 80))
    assert model.score("a disgustting thing in the green garden") > 0.5 > model.score("a river in the green garden by the window")


# ------------------------------------------------------------------ the pipeline


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = common.table(spark, DATA, "documents")
    for name, stage in pipeline.STAGES[:-1]:
        kept = common.cut(stage(spark, docs, DATA), "test")
        assert kept.columns == docs.columns and kept.count() <= docs.count(), name
        if name == "near_dedup":
            got = near_dedup.near_duplicates(docs)
            assert kept.count() == got.filter("kept").count()
        docs = kept
    rows = pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r[0] for r in rows.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_pipeline_on_odd_rows(spark, odd, none):
    """Every stage on nulls, repeated rows, clashing columns, tables without n_chars, and none at all."""
    pipeline = pytest.importorskip("corpus_pipeline")
    clean = "The garden by the river is green and the water runs past it all day long. " * 8
    rows = [(i, t) for i, t in ODD if t is None or len(t) < 50_000] + [(50, clean), (51, clean), (50, clean), (52, clean + "And more. "), (None, clean)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("n_lines", "n_dropped", "row", "lost", "comp", "rep", "__x", "score", "place", "part", "uid", "rest"):
        df = df.withColumn(c, F.lit("clash"))
    for name, stage in pipeline.STAGES:
        out, empty = stage(spark, df, DATA), stage(spark, df.limit(0), DATA)
        assert empty.count() == 0 and (name == "packing" or out.columns == df.columns), name
        got = Counter((r["doc_id"], r["text"]) for r in out.collect()) if name != "packing" else None
        if name in ("toxicity", "quality"):
            assert not got - Counter((i, t) for i, t in rows), name
        if name == "line_dedup":
            assert got == Counter((i, t) for i, _, _, t in plain_lines(rows))
        if name == "near_dedup":
            components = plain_components(rows, near_dedup.WORDS, near_dedup.PERCENT)
            heads = {i for i, _, c in components if i is not None and i == c}
            assert Counter(i for i, _ in got.elements() if i is not None) == Counter(heads)
            assert sum(n for (i, _), n in got.items() if i is None) == sum(i is None for i, _ in rows)
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {i for i, _ in rows}


def test_hash_of_words():
    for t in ("", " ", "a", " a  b\tc\x0bd ", "é 日本 x" * 50):
        start, end = common.words(t.encode())
        assert [t.encode()[a:b] for a, b in zip(start, end, strict=True)] == t.encode().split()
        h = common.word_hashes(t.encode())
        assert [h[i] == h[j] for i in range(len(h)) for j in range(len(h))] == [a == b for a in t.split() for b in t.split()]
    assert hashlib.sha256(b"").hexdigest() and os.path.isdir(DATA)
