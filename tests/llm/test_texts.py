"""Extraction, language, tokens and test passages, against small fixtures and the libraries."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowscope.llm import bpe_chunks, decontaminate, language_id, main_text, token_counts
from flowscope.llm.queries import vocabulary

WORD_BPE = vocabulary("word_bpe_49k.json")
PIECES = vocabulary("piece_bpe_32k.model")
ODD = ["a", "The ", "  ", "\n", "\t", "\x1c", "▁", "é", "É", "é", "́", "Σ", "İ", "<|endoftext|>", "<s>",
       "'s", "1", "!!", "​", "日本", "x" * 50, "\x00", "　", "😀", " ", ". ", ",\n", "J̌", "ﬁ"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        some = rng.sample(ODD, rng.choice([4, 10, len(ODD)]))
        yield "".join(rng.choices(some, k=rng.choice([0, 1, 3, 10, 60, 700, 1500])))


# --- main text -----------------------------------------------------------------------------

PAGES = {
    # unclosed tags, a script that holds one, menus, notices and a footer
    '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href=/>Home</a></nav>'
    '<div class="ad">Buy, buy</div><article><h1>Head &amp; line</h1><p>One<br>two, <b>bo</b>ld<p>three &lt;3'
    "</article><footer>&copy; us</footer>": "Head & line One two, bold three <3",
    # no article element: the best container by its paragraphs
    '<body><div id="top-menu"><a>x</a> <a>y</a></div><div class="content-with-sidebar"><div class="sidebar">'
    "<p>Beside, the text, but long enough to count as well.</p></div><div class=body><p>First, with commas, and "
    "enough words to be a paragraph.</p><ul><li>a<li>b</ul></div><div id=comments><p>Nice, really nice, I liked "
    "it a lot, thanks.</p></div></div><form><p>Sign up</p></form>":
        "First, with commas, and enough words to be a paragraph. a b",
    "<main><header><h1>T</h1><i>by x</i></header><section><p>One.</p></section><section><p>Two.</p></section>"
    "<aside>rel</aside></main>": "T One. Two.",
    "plain &lt;b&gt; text": "plain <b> text",
    "<p>a</p><p>b<": "a b<",
    "<div>" * 5_000 + "deep": "deep",
    "<!-- only -->": "", "": "", None: "",
}


@pytest.mark.parametrize("page", PAGES, ids=range(len(PAGES)))
def test_main_text(page):
    assert main_text.main_text(page) == PAGES[page]


BESIDE = {
    # several articles, also a short one beside a long one and in wrappers of their own
    "<body><article><p>One, two, three.</p></article><article><p>Four.</p></article></body>": "One, two, three. Four.",
    "<body><div><div><article>" + "<p>Long, long, long, long.</p>" * 90 + "</article></div><div><article><p>Short.</p>"
    "</article></div></div><div><a href=/>Home</a></div></body>": "Long, long, long, long. " * 90 + "Short.",
    # text beside an article
    "<main><p>lede</p><article><p>One, two.</p></article><p>rest</p></main>": "lede One, two. rest",
    "<main>Loose <b>te</b>xt<div><article><p>One, two.</p></article><div>beside</div></div><section><p>rest, "
    "<a href=/>see</a></p></section><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></main><footer>us</footer>":
        "Loose text One, two. beside rest, see",
    "<body><p>lede</p><article><p>One, two.</p></article><div><a href=/>More</a></div><p>rest</p></body>":
        "lede One, two. rest",
    "<main><p>One, two, three.</p></main><article><p>Four.</p></article>": "One, two, three. Four.",
}


@pytest.mark.parametrize("page", BESIDE, ids=range(len(BESIDE)))
def test_main_text_beside_an_article(page):
    assert main_text.main_text(page) == BESIDE[page]


ARTICLE = "<h1>The head</h1><p>One, two, three, and some more words to fill it up.</p><p>Four, five, and six.</p>"
TOLD = "The head One, two, three, and some more words to fill it up. Four, five, and six."
COMMENTS = "<p>Nice, really nice, I liked it a lot, thanks.</p>" * 12
MARKED = {
    # wrappers whose class or id holds a word for surroundings, and forms around the page
    f'<body><div class="entry-content comments-open">{ARTICLE}</div></body>': TOLD,
    f'<body><div class="page-wrap notice-free">{ARTICLE}</div><footer>us</footer></body>': TOLD,
    f'<body><div class="content widget-content">{ARTICLE}</div></body>': TOLD,
    f'<body><form action="/"><input name=q>{ARTICLE}<button>Go</button></form></body>': TOLD,
    f'<body><form><div class="page-wrap notice-free"><div class="sidebar">{ARTICLE}</div>'
    '<div class="newsletter"><p>Sign up, please, it is free.</p></div></div></form></body>': TOLD,
    # the words still do their work beside an article, however long what they name is
    f'<body><div class="post">{ARTICLE}</div><div class="comments">{COMMENTS}</div></body>': TOLD,
    f'<body><div>{ARTICLE}</div><form><p>Subscribe, to get more, every day.</p></form></body>': TOLD,
    f'<body><article>{ARTICLE}<div class="related-posts"><p>Other, other, other things to read.</p></div></article></body>': TOLD,
    # chapters and paragraphs of an article, and formulas
    f'<article>{ARTICLE}<section id="related-work"><p>Others did it, too.</p></section></article>': f"{TOLD} Others did it, too.",
    f'<article>{ARTICLE}<p class="social">Society, at large.</p><p>As <math><mi>x</mi></math> is.</p></article>':
        f"{TOLD} Society, at large. As x is.",
    # sources stay, menus go
    f'<article>{ARTICLE}<ul><li><a href="https://a.org/1">Source one</a><li><a href="https://b.org/2">Source two</a></ul>'
    '<ul><li><a href="/x">More</a><li><a href="/y">Even more</a></ul></article>': f"{TOLD} Source one Source two",
    # parallel wrappers
    "<body><div id=a><div><p>One, two, three, four.</p></div></div><div id=b><div><p>Five, six, seven, eight.</p></div></div>"
    "</body>": "One, two, three, four. Five, six, seven, eight.",
    # cards that lead elsewhere are no further articles
    f"<body><article>{ARTICLE}</article><div><article><h3><a href=/o>Other story</a></h3><p>What it tells, in short.</p>"
    "</article></div></body>": TOLD,
    f"<main><article>{ARTICLE}</article><article><a href=/o><h3>Other story</h3></a><p>In short.</p></article></main>": TOLD,
}


@pytest.mark.parametrize("page", MARKED, ids=range(len(MARKED)))
def test_marked_elements(page):
    assert main_text.main_text(page) == MARKED[page]


def plain_scores(page):
    """The points of every container, by the rules, element by element."""
    root = main_text.parse(page)
    main_text.prune(root)
    every = main_text.in_order(root)

    def size(node, linked=False, inside=False):
        """Characters, or those in links at or below the element that was asked for."""
        inside = inside or node.tag == "a"
        return sum(size(c, linked, inside) if not isinstance(c, str) else
                   len(" ".join(c.split())) if inside or not linked else 0 for c in node.children)

    def commas(node, top=True):
        return sum(c.count(",") if isinstance(c, str) else 0 if top and c.tag in main_text.BLOCKS else commas(c, False)
                   for c in node.children)

    scores = {}
    for node in every:
        block = node.tag in main_text.PARAGRAPHS
        loose = not block and (node.tag in main_text.BLOCKS or not node.tag) and any(
            isinstance(c, str) and c.strip() for c in node.children)
        n = size(node)
        if not n or not (block or loose):
            continue
        points = (min(n / 25, 1) + commas(node) + min(n / 100, 3)) * (1 - size(node, True) / n)
        above, level = node if loose else node.parent, 1
        while above is not None and above.tag != "html":
            own = main_text.attributes(above)
            words = {w for x in main_text.names(f"{own.get('class', '')} {own.get('id', '')}") for w in x}
            favour = 25 if above.tag in ("article", "main") else 10 if words & main_text.FAVOURED else 5 * (above.tag == "div")
            scores.setdefault(id(above), [above, favour])[1] += points / level
            above, level = above.parent, 2 if level == 1 else level * 1.5
    return {id(n): (n.tag, round(s, 6)) for n, s in scores.values()}, every


@pytest.mark.parametrize("seed", range(40))
def test_scores_of_random_trees(seed):
    """Against the rules written out without shared sums, on trees of random tags, links and texts."""
    rng = random.Random(seed)

    def tree(depth):
        tag = rng.choice(["div", "p", "section", "a", "b", "ul", "li", "article", "blockquote", "td"])
        mark = rng.choice(["", "", ' class="post"', ' id="content"'])
        inner = "".join(tree(depth - 1) if depth and rng.random() < 0.6 else rng.choice(["text, ", "a, b, c ", "x" * 130, " "])
                        for _ in range(rng.randrange(4)))
        return f"<{tag}{mark}>{inner}</{tag}>"

    page = f"<body>{''.join(tree(5) for _ in range(3))}</body>"
    want, every = plain_scores(page)
    root = main_text.parse(page)
    main_text.prune(root)
    found = main_text.score(root)
    got = sorted((n.tag, round(n.score, 6)) for n in found)
    assert got == sorted(want.values()) and len(every) == len(main_text.in_order(root))


def test_a_long_page_is_read_in_one_go():
    page = f"<body><div class=post>{'<p>One, <a href=/x>two</a>, three.</p>' * 60_000}</div><div class=comments>{COMMENTS}</div></body>"
    begin = time.monotonic()
    assert main_text.main_text(page) == " ".join(["One, two, three."] * 60_000)
    assert time.monotonic() - begin < 30


def test_extract_keeps_rows(spark):
    rows = [(i, "clash", page) for i, page in enumerate(PAGES)] + [(None, "clash", None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, text string, html string")
    got = main_text.extract(pages, ["page_id", "text"]).collect()
    want = [(i, PAGES[page]) for i, page in enumerate(PAGES)] + [(None, "")] * 2
    assert sorted(map(str, ((r.page_id, r.text) for r in got))) == sorted(map(str, want))
    assert main_text.extract(pages.limit(0), ["page_id"]).collect() == []


# --- tokens ----------------------------------------------------------------------------------

def test_token_lengths_equal_the_library():
    model, cache = token_counts.load_model(PIECES), {}
    for t in odd_texts(400, 1):
        assert token_counts.text_length(t, model, {"the": 1}, cache) == len(model.encode(t))


def test_count_tokens(spark):
    texts = [None, "", " ", "a b a b", "a  b ", "word " * 5_000, "same", "same"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, PIECES).collect()}
    model = token_counts.load_model(PIECES)
    assert got == {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(docs.limit(0), PIECES).collect() == []


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORD_BPE), bpe_chunks.Encoder(WORD_BPE)
    for t in odd_texts(400, 2):
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", [
    "".join(random.Random(1).choices("abcdefghijklmnop", k=1_000_000)),
    "".join(random.Random(2).choices("日本語漢字文章中国人民大学生", k=1_000_000)),
    "start of it " + "x" * 40_000 + " between " + "é" * 40_000 + ".\n" + "end",
], ids=["letters", "characters", "between"])
def test_unbroken_text_takes_linear_time(text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    begin = time.monotonic()
    want = library.encode(text, add_special_tokens=False).ids
    middle = time.monotonic()
    assert bpe_chunks.Encoder(WORD_BPE).encode(text) == want
    assert time.monotonic() - middle < 3 * (middle - begin) + 3


def test_chunks_are_shared_and_whole():
    rng = random.Random(3)
    passage = " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(3_000))
    one, two = list(bpe_chunks.chunks_of("x " * 700 + passage)), list(bpe_chunks.chunks_of("y " * 333 + passage))
    assert "".join(one) == "x " * 700 + passage
    assert len(set(one) & set(two)) > 0.7 * min(len(one), len(two))


def test_encode_and_decode(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    texts = [None, "", "Hello, World", "a" * 9_000, "long text. " * 2_000, "copy", "copy"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded = bpe_chunks.encode(docs, WORD_BPE)
    for r in bpe_chunks.decode(encoded, WORD_BPE).collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe_chunks.encode(docs.limit(0), WORD_BPE, decoded=True).collect() == []


# --- test passages -----------------------------------------------------------------------------

def brute_force(texts, items, window):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases, found = {}, []
    for i, t in items:
        words = word.findall(t.encode().lower())
        for k in range(max(1, len(words) - window + 1) if words else 0):
            phrases.setdefault(tuple(words[k:k + window]), set()).add(i)
    for t in texts:
        words, hit, own = word.findall((t or "").encode().lower()), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(words) - n + 1):
                p = tuple(words[k:k + n])
                if p in phrases:
                    hit |= set(range(k, k + n))
                    own |= phrases[p]
        found.append((len(words), len(hit), own))
    return found


@pytest.mark.parametrize("seed", range(30))
def test_fm_index_search(seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "dd", "é", "x!"][:rng.choice([2, 3, 6])]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 6])))) for i in range(rng.choice([0, 1, 4]))]
    texts = [" ".join(rng.choices(words + ["zz"], k=rng.choice([0, 1, 5, 60, 200]))) for _ in range(5)] + [None]
    texts += texts * rng.choice([0, 1])
    phrases = decontaminate.Phrases(items, 3)
    sizes, spans, own = decontaminate.search_shard(texts, phrases)
    got = [(n, sum(int(e - b) for b, e in s), {phrases.items[i] for i in x}) for n, s, x in zip(sizes, spans, own)]
    assert got == brute_force(texts, items, 3)


def test_find_items(spark, monkeypatch):
    items = [(1, "one two three four"), (2, "three four five six"), (3, "Hi"), (4, None), (None, "one two three")]
    texts = ["zero ONE two, three four five six!", "hi", None, "", "one two", "one two three four five"] * 2
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_force(texts, [x for x in items if x[0] and x[1]], 3)

    def check():
        rows = decontaminate.find_items(docs, bench, window=3).withColumn("hit", decontaminate.hit_words())
        assert {r.doc_id: (r.n_words, r.hit, set(r["items"])) for r in rows.collect()} == dict(enumerate(want))

    check()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 4)  # several blocks
    check()
    assert decontaminate.find_items(docs.limit(0), bench).collect() == []
    assert decontaminate.find_items(docs, bench.limit(0)).filter(F.size("spans") > 0).collect() == []
    monkeypatch.undo()
    assert decontaminate.decontaminated(docs, bench).columns == docs.columns


@pytest.mark.parametrize("block_words", [4, 1_000_000])
def test_rows_keep_their_multiplicity(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(decontaminate, "WINDOW", 3)  # of decontaminated()
    items = [(1, "one two three four"), (2, "three four five six"), (3, "Hi")]
    rows = [(None, "one two three four"), (None, "four five six"), (None, "clean"), (None, "clean"), (None, None),
            (7, "hi"), (7, "hi"), (7, "other"), (7, "one two three four five six"), (8, "x"), (8, "x"), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_force([t for _, t in rows], items, 3)
    found = decontaminate.find_items(docs, bench, window=3).withColumn("hit", decontaminate.hit_words())
    got = [(r.doc_id, r.n_words, r.hit, r["items"]) for r in found.collect()]
    assert sorted(map(str, got)) == sorted(str((i, n, h, sorted(x))) for (i, _), (n, h, x) in zip(rows, want))
    clean = [row for row, (_, h, _) in zip(rows, want) if not h]
    got = decontaminate.decontaminated(docs, bench, "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, clean))


# --- language ------------------------------------------------------------------------------------

def test_forward_sums_all_segmentations():
    pieces = language_id.Pieces(["a", "b", "ab", "▁", "▁a", "▁ab", "ba"])
    rng = np.random.default_rng(1)
    probabilities = np.concatenate([np.zeros((1, 2)), rng.dirichlet(np.ones(7), 2).T])

    def total(rest, language):
        if not rest:
            return 1.0
        return sum(
            probabilities[i + 1, language] * total(rest[len(p):], language)
            for i, p in enumerate(pieces.pieces) if rest.startswith(p))

    for word in ("a", "ab", "abab", "bbab"):
        got = language_id.word_scores(pieces, probabilities, [word])[0]
        assert np.allclose(np.exp(got), [total("▁" + word, k) for k in (0, 1)])


@pytest.fixture(scope="module")
def vocabulary_model():
    pieces = language_id.Pieces(language_id.read_pieces(PIECES))
    rng = np.random.default_rng(3)
    probabilities = np.concatenate([np.zeros((1, 2)), rng.dirichlet(np.full(len(pieces.pieces), 0.5), 2).T])
    return language_id.Model(pieces, probabilities, ["aa", "bb"])


def log_sum_over_cuts(model, word):
    """Over all cuts of a word into pieces of any length, in logarithms."""
    known = {p: model.probabilities[i + 1] for i, p in enumerate(model.pieces.pieces)}
    text, sums = language_id.SPACE + word, [np.zeros(2)]
    for end in range(1, len(text) + 1):
        parts = []
        for begin in range(end):
            weight = known.get(text[begin:end], np.zeros(2))
            if end - begin == 1:
                weight = np.maximum(weight, language_id.UNSEEN)
            if weight.any():
                parts.append(sums[begin] + np.log(np.maximum(weight, 1e-320)))
        sums.append(np.logaddexp.reduce(parts))
    return sums[-1]


def test_no_piece_and_no_word_is_too_long(vocabulary_model):
    """Words of 1 to 300 letters, with the longest pieces in them, also across a block of positions."""
    model, rng = vocabulary_model, random.Random(5)
    longest = sorted(model.pieces.pieces, key=len)[-30:]
    assert model.pieces.longest == len(longest[-1]) >= 14
    plain = [p for p in model.pieces.pieces if p.isalpha()]
    words = [p.strip("▁") for p in longest] + ["".join(rng.choices(plain + longest, k=k)).replace("▁", "") for k in (3, 8, 20, 40)]
    words += ["a" * n for n in (1, 47, 48, 49, 60, 300)] + ["ab" * 30, "日本語" * 40, "ǅ" * 70]
    got = language_id.word_scores(model.pieces, model.probabilities, words)
    for word, scores in zip(words, got):
        assert np.allclose(scores, log_sum_over_cuts(model, word), rtol=1e-9), word
    before = language_id.POSITIONS
    language_id.POSITIONS = 7
    try:
        again = language_id.word_scores(model.pieces, model.probabilities, words)
    finally:
        language_id.POSITIONS = before
    assert np.allclose(again, got, rtol=1e-12)
    begin = time.monotonic()
    assert np.isfinite(language_id.long_word_score(model.pieces, model.probabilities, "abc" * 100_000)).all()
    assert time.monotonic() - begin < 30


def test_long_words_count_among_others(vocabulary_model):
    model, long = vocabulary_model, "straßenbahn" * 20
    alone = [model.scores([w]) for w in ("one", long, "two")]
    assert np.allclose(model.scores(["one", long, "two"]), sum(alone))
    assert long not in model.cache


def test_numerals_are_no_letters(vocabulary_model):
    model = vocabulary_model
    assert language_id.words_of("½ ② ² Ⅷ 一二 x²y ٣ ͵") == ["一二", "x", "y"]
    names, scores = model.predict(["½ ② ²", "3²", "", None, "x²"])
    assert names[:4] == ["und"] * 4 and names[4] != "und" and scores[:4] == [0.0] * 4
    for c in map(chr, range(0x110000)):
        assert bool(language_id.words_of(c)) == any(x.isalpha() for x in c.lower())


def test_ties_go_to_the_first_language():
    pieces = language_id.Pieces(["a", "b", "▁"])
    model = language_id.Model(pieces, np.full((4, 3), 0.25), ["aa", "bb", "cc"])
    names, scores = model.predict(["ab ba", "a"])
    assert names == ["aa", "aa"] and np.allclose(scores, 1 / 3)


def test_language_id(spark):
    rng = random.Random(4)
    parts = {"aa": ["kel", "to", "mira", "su"], "bb": ["grø", "ents", "wick", "ol"]}

    def text(lang, n):
        return " ".join("".join(rng.choices(parts[lang], k=rng.choice([1, 2, 3]))) for _ in range(n))

    rows = [(i, text(lang, 30), lang) for i in range(60) for lang in parts]
    rows += [(100 + i, None, "aa") for i in range(3)] + [(200, text("aa", 5), None)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(labelled, PIECES)
    assert model.languages == ["aa", "bb"]
    asked = [(0, text("aa", 8)), (1, text("bb", 8).upper()), (2, None), (3, ""), (4, "12 ?!"), (5, text("bb", 1) * 3_000)]
    docs = spark.createDataFrame([(i, t, "zz", 1.0) for i, t in asked], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    assert [got[i][0] for i in range(6)] == ["aa", "bb", "und", "und", "und", "bb"]
    assert all(0.0 <= s <= 1.0 for _, s in got.values()) and got[2][1] == 0.0
    empty = language_id.train(labelled.limit(0), PIECES)
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).collect() == []


def test_held_out_accuracy(spark):
    """At least 98 in 100 of the texts that the models have not seen."""
    from flowscope.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    got = queries.op3_language_id(spark, "/root/testdata/sf0.001").filter("held_out").join(docs, "doc_id")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right >= 0.98 * n


def test_bpe_query(spark):
    from tokenizers import Tokenizer

    from flowscope.llm import queries

    library, folder = Tokenizer.from_file(WORD_BPE), "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op4_bpe_chunks(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
