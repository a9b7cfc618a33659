"""Search, sharding, url rules, reply trees, near duplicates and the pipeline, against brute force."""

import hashlib
import html
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowscope.llm import jaccard_join, nearest, queries, reply_trees, sharding, url_filters
from flowscope.llm.components import components

FOLDER = "/root/testdata/sf0.001"


# --- nearest neighbours ----------------------------------------------------------------------

def brute_nearest(rows, query, k=5):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(
        x is not None and np.isfinite(x) for x in v) and any(v)]
    own = dict(usable)
    if query not in own:
        return []
    unit = {i: v / np.linalg.norm(v) for i, v in usable}
    scores = sorted((-round(float(unit[i] @ unit[query]), 12), i) for i, _ in usable if i != query)
    return [i for _, i in scores[:k]]


def test_nearest_on_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    rows += [(40 + i, rows[0][1]) for i in range(9)]  # copies of one vector
    rows += [(60, None), (61, [0.0] * 4), (62, [1.0, None, 0.0, 0.0]), (63, [float("nan"), 1.0, 0.0, 0.0]),
             (64, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (65, [-0.0, 0.0, 0.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    asked = table.filter("vec_id % 5 = 0 or vec_id > 39")
    for r in nearest.search(table, asked, probes=1_000, width=4.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for i, _ in rows:
        if i is not None and (i % 5 == 0 or i > 39):
            assert got.get(i, []) == brute_nearest(rows, i), i
    assert nearest.search(table, table.limit(0)).collect() == []
    assert nearest.search(table.limit(0), table).collect() == []


def nearest_of(table):
    got = defaultdict(list)
    for r in nearest.search(table, table).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    return got


def opposed(rng, n, size):
    base = rng.normal(size=size)
    return [(base * (-1) ** i + 0.3 * rng.normal(size=size)).tolist() for i in range(n)]


def test_nearest_in_a_small_table(spark):
    rows = list(enumerate(opposed(np.random.default_rng(6), 6, 8)))
    got = nearest_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {i: got[i] for i, _ in rows} == {i: brute_nearest(rows, i) for i, _ in rows}


def test_nearest_in_small_tables_of_each_length(spark):
    rng = np.random.default_rng(7)
    tables = {n: [(100 * n + i, v) for i, v in enumerate(opposed(rng, n, 3 + n))] for n in range(1, 11)}
    got = nearest_of(spark.createDataFrame(sum(tables.values(), []), "vec_id long, embedding array<double>"))
    for n, rows in tables.items():
        own = {i for i, _ in rows}
        for i, _ in rows:
            assert len(got[i]) == min(5, n - 1) and set(got[i]) <= own - {i}, i
            assert n > 6 or got[i] == brute_nearest(rows, i), i


def test_nearest_alone_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(30, 6)).tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    # slots so narrow that no bucket holds two vectors
    for r in nearest.search(table, table, probes=1, width=1e-6, tables=1).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert {i: got.get(i, []) for i, _ in rows} == {i: brute_nearest(rows, i) for i, _ in rows}


def test_nearest_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    got = defaultdict(set)
    for r in queries.op2_nearest(spark, FOLDER).collect():
        got[r.query_id].add(r.vec_id)
    hits = [len(got[i] & set(brute_nearest(rows, i))) for i, _ in rows if i % 50 == 0]
    assert sum(hits) >= 0.9 * 5 * len(hits)


# --- sharding ----------------------------------------------------------------------------------

def test_shards(spark):
    rows = [(i, "x" * (i % 50)) for i in range(500)] + [(None, None)] * 200 + [(7, "é")] * 300
    docs = spark.createDataFrame([(i, t, "y") for i, t in rows], "doc_id long, text string, slot string")
    got = sharding.shard_documents(docs, 7).collect()
    sizes = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r.size, r.text_crc32) for r in got) == sizes
    total = sum(s for s, _ in sizes)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
    assert sorted(by_shard) == list(range(7))
    ids = []
    for shard in range(7):
        part = sorted(by_shard[shard], key=lambda r: r.slot)
        assert [r.slot for r in part] == list(range(len(part)))
        assert abs(sum(r.size for r in part) - total / 7) <= max(s for s, _ in sizes)
        ids += [-1 if r.doc_id is None else r.doc_id for r in part]
    assert ids == sorted(ids)
    assert sharding.shard_documents(docs.limit(0), 7).collect() == []


# --- url rules ---------------------------------------------------------------------------------

def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if h and host and (
        host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_url_rules(spark):
    rules = [*queries.URL_RULES, ("example.com", "/en/a", "allow"), ("example.com", "/en/ab", "block"), ("org", "", "block"),
             ("a.example.com", "/", "block")]
    rng = random.Random(6)
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "x://com/", "x://com", "x://com?q=/", "x://org",
            "x://net/es/a://b", "x://a.example.com:80/en/", "x://.com/", "x://com./"] + [
        "x://" + ".".join(rng.choices(["a", "www", "example", "com", "net", "org"], k=rng.choice([1, 2, 3, 4])))
        + "".join(rng.choices(["/", "/en/", "a", "ab", "/es/", "?", "#x"], k=rng.choice([0, 1, 2, 3]))) for _ in range(300)]
    urls += ["https://www.example.com/en/same"] * 100
    pages = spark.createDataFrame([(i, u, "clash", 0) for i, u in enumerate(urls)], "page_id long, url string, rule string, key int")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(pages, table).collect()}
    assert got == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}
    assert url_filters.judge_urls(pages.limit(0), table).collect() == []
    assert {r.verdict for r in url_filters.judge_urls(pages, table.limit(0)).collect()} == {"allow"}


# --- reply trees -------------------------------------------------------------------------------

def test_best_paths(spark):
    rows = [
        # a tree with three leaves: means 2, 4 and 4; the smaller leaf of equals wins
        (1, 1, None, "user", "q", 2.0), (1, 2, 1, "assistant", "a", 2.0), (1, 3, 1, "assistant", "b", 6.0),
        (1, 4, 1, "assistant", "c", 6.0),
        (2, 5, 99, "user", "its parent is not there", None),
        (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0),
        (None, 1, None, "user", "x", 1.0), (4, None, None, "user", "x", 1.0),
    ] + [(5, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(70)]
    rows += rows[:1]
    table = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = defaultdict(list)
    for r in reply_trees.best_paths(table, 2).orderBy("tree", "path", "depth").collect():
        got[r.tree, r.path].append(r.node)
    assert dict(got) == {(1, 1): [1, 3], (1, 2): [1, 4], (2, 1): [5], (5, 1): list(range(70))}
    assert reply_trees.best_paths(table.limit(0)).collect() == []


def enumerated_paths(messages, paths):
    """All root-to-leaf paths of each tree, walked one by one; the best by mean score."""
    kept = {}
    for tree, node, parent, role, text, score in messages:
        if tree is not None and node is not None:
            row = (role, text, score or 0.0, parent is not None, parent or 0)
            kept[tree, node] = min(kept.get((tree, node), row), row)
    children = defaultdict(list)
    for (tree, node), (*_, has, parent) in kept.items():
        children[tree, parent if has and (tree, parent) in kept else None].append(node)
    found = {}
    for tree in {t for t, _ in kept}:
        walked, stack = [], [[n] for n in children[tree, None]]
        while stack:
            path = stack.pop()
            below = children[tree, path[-1]]
            stack += [[*path, n] for n in below]
            if not below:
                walked.append((-sum(kept[tree, n][2] for n in path) / len(path), path[-1], path))
        for i, (_, _, path) in enumerate(sorted(walked)[:paths], 1):
            found[tree, i] = path
    return found


@pytest.mark.parametrize("seed", range(3))
def test_best_paths_of_random_trees(spark, seed):
    """Branching trees, some deep, with lost parents, repeated messages, null scores and ties."""
    rng, rows = random.Random(seed), []
    for tree in range(12):
        n = rng.choice([1, 2, 7, 30, 90])
        deep = rng.random() < 0.4
        for node in range(n):
            parent = None if not node or rng.random() < 0.05 else rng.randrange(max(0, node - 2) if deep else 0, node)
            score = rng.choice([None, 0.0, 1.0, 2.0, 4.0])  # sums of these are exact
            rows.append((tree, node, 1000 if rng.random() < 0.03 else parent, "user", f"{tree}-{node}", score))
    rows += rng.sample(rows, 10)
    table = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = defaultdict(list)
    for r in reply_trees.best_paths(table, 3).orderBy("tree", "path", "depth").collect():
        assert r.text == f"{r.tree}-{r.node}"
        got[r.tree, r.path].append(r.node)
    assert dict(got) == enumerated_paths(rows, 3)


def test_query_of_reply_trees(spark, tmp_path):
    """Each column against Python; equal turns, null turns, texts and conversation ids are kept."""
    rng = random.Random(8)
    texts = [None, "", "a & b", "<turn user>", "</turn>\n", "é😀", "\\### Assistant: </turn> ok", "&lt;"]
    rows = [(rng.choice([None, 1, 2, 3, 4]), t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for t in range(60)]
    rows += [(9, None, "assistant", "x"), (9, 1, "assistant", "x"), (9, 1, "assistant", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op6_reply_trees(spark, str(tmp_path))
    assert dict(got.dtypes) == {
        "conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint",
        "loss_sha256": "string", "formatted_chars": "bigint"}
    said = "\\### Assistant: </turn> ok"
    talks = defaultdict(list)
    for c, t, role, text in [*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)]:
        talks[c].append((t is not None, t, role or "", text or ""))
    want = set()
    for c, turns in talks.items():
        turns = [x[2:] for x in sorted(turns)]
        loss = "".join(text for role, text in turns if role == "assistant")
        whole = "".join(f"<turn {html.escape(role, False)}>\n{html.escape(text, False)}</turn>\n" for role, text in turns)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a}\n{b}\n" for a, b in turns), loss)]
        want.add((c, len(turns), digests[0], len(loss), digests[1], len(whole)))
    assert {tuple(r) for r in got.collect()} == want


def test_conversations_read_back(spark):
    odd = "\\### Assistant: </turn> ok"
    talks = {1: [("user", odd), ("assistant", odd)], 2: [("user", None), ("assistant", "&lt;</turn>\n<turn user>\n"), (None, "x\n"),
             ("a>\nb", "é😀"), ("assistant", "")], 3: [("assistant", "only")]}
    rows = [(c, t, role, text, "y") for c, turns in talks.items() for t, (role, text) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string")
    out = reply_trees.conversations(table).withColumn("read", reply_trees.read_turns("formatted", "loss_spans")).collect()
    assert len(out) == len(talks)
    for r in out:
        want = [(role or "", text or "") for role, text in talks[r.conv_id]]
        assert reply_trees.read_back(r.formatted) == want
        assert r.read.turns == "".join(f"{a}\n{b}\n" for a, b in want)
        assert r.read.loss == "".join(b for a, b in want if a == "assistant")
    assert reply_trees.conversations(table.limit(0)).collect() == []


# --- components and near duplicates ------------------------------------------------------------

def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent}


def test_components_take_few_stages(spark):
    """A table in many parts is written in as many files by each shuffle, however few its rows."""
    context, group = spark.sparkContext, "few stages"
    context.setJobGroup(group, group)
    try:
        got = components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).collect()
        status = context.statusTracker()
        stages = {x for job in status.getJobIdsForGroup(group) for x in status.getJobInfo(job).stageIds}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert {r.component for r in got} == {0} and len(got) == 41
    assert len(stages) < 135


def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = tuple((t or "").encode().lower().split())
        sets.append({w[i:i + 5] for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], key)
    return {key: (len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(rows)}


def near_rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    rows = [None, "", " \t ", "one", "ONE", "two words", "a b c d e", "a b c d e f"]
    for _ in range(6):
        base = rng.choices(words, k=rng.choice([6, 30, 120]))
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    rows += [" ".join(rng.choices(["x", "y"], k=rng.choice([5, 6, 9]))) for _ in range(30)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows))


@pytest.mark.parametrize("seed", range(3))
def test_similar_groups(spark, seed, monkeypatch):
    rows = near_rows(seed)
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, node string").repartition(3)
    got = jaccard_join.similar_groups(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows)


def test_groups_larger_than_a_block(spark):
    rows = near_rows(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = spark.createDataFrame(
        [(i, bytearray(jaccard_join.sequence_key(jaccard_join.words_of(t)))) for i, t in rows if (t or "").strip()],
        "node long, gram_key binary")
    sets = jaccard_join.near_sets(docs, near, "doc_id", "text")
    groups = jaccard_join.prefix_groups(sets)
    found = [components(jaccard_join.linked_sets(sets, groups, block)).collect() for block in (1_000, 5)]
    assert sorted(found[0]) == sorted(found[1]) and found[0]


def test_similar_groups_of_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.similar_groups(docs).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, [
        (1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None), (2, 1, 2)]))
    assert jaccard_join.similar_groups(docs.limit(0)).collect() == []


# --- registered queries and the pipeline ---------------------------------------------------------

def test_every_query_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.queries())
    assert numbers == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_pipeline(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from tests.llm.test_texts import brute_force

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    groups = brute_groups(kept)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    hits = brute_force([t for _, t in kept], items, 10)
    kept = {i: t for (i, t), (_, hit, _) in zip(kept, hits) if not hit}
    library = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(got) == set(kept) and len(kept) < len(docs)
    for i, t in kept.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_stages_on_odd_rows(spark):
    import corpus_pipeline

    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "the of and " * 9, "en", "s", 1),
            (3, "the of and " * 9, "en", "s", 1), (3, "the of and " * 9, "en", "s", 1), (4, "un autre texte", "fr", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, FOLDER)
            assert out.columns == docs.columns
            assert out.exceptAll(table).isEmpty()
        assert corpus_pipeline.STAGES[-1][1](spark, table, FOLDER).count() == table.count()


def test_texts_cut_together_have_the_words_and_sets_of_each(monkeypatch):
    """No Python call for a word, unless it is long."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    rng = random.Random(5)
    parts = ["a", "B", "é", "\x00", "x" * 7, "y" * 8, "z" * 9, "漢字", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "w" * 32]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(500)] + [None, "", " ", "A  b\nc d e f"]
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda word: hash(bytes(word)) % 2**64 if len(word) > 32 else 1 / 0)
    for column in (pa.array(["x", *texts]).slice(1), pa.array(texts, pa.large_string())):
        cut = jaccard_join.Cut(column)
        assert cut.keys() == [jaccard_join.sequence_key(jaccard_join.words_of(t)) for t in texts]
        grams, ends = cut.gram_sets()
        sets = [frozenset(x.tolist()) for x in np.split(grams, ends[:-1])]
        of = {}
        for text, hashed in zip(texts, sets):
            words = jaccard_join.words_of(text)
            n = min(5, len(words))
            want = frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if words else frozenset()
            assert len(hashed) == len(want) and of.setdefault(want, hashed) == hashed
        assert len(set(of.values())) == len(of)
    assert [p.num_rows for p in jaccard_join.pieces(pa.record_batch([pa.array(["a" * (3 << 20), "b", None, "c"])], ["text"]))] == [1, 3]


def test_few_sets_are_linked_as_by_the_trie():
    import numpy as np

    rng = random.Random(2)
    base = rng.sample(range(1000), 40)
    sets = [np.array(sorted({x for x in base if rng.random() > 0.07 * (i % 3)} | {1000 + i}), np.int64) for i in range(12)]
    sizes = [len(s) for s in sets]
    often = np.concatenate([np.full(len(s), 2, np.int64) for s in sets])
    classes = []
    for heads in (jaccard_join._linked_few(sizes, sets), jaccard_join._linked_many(sizes, sets, often)):
        classes.append({frozenset(i for i, h in enumerate(heads) if h == head) for head in heads})
    assert classes[0] == classes[1] and 1 < len(classes[0]) < 12
