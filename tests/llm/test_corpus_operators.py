"""The ten operators against brute force and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
from rastermill.llm import decontaminate, graph, html, langid, lines, mixing, neighbours, queries, sharding, simhash, substrings, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, fingerprint string, score double, size int, __bin int"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, equal ids, and columns with clashing names."""
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (5, "one"), (6, "other text under six"), (6, "another text under six"), (None, "no id"), (7, long), (8, long), (9, "123 456"), (10, "é\x00  ü"), (11, "a b c " * 30)]
    return spark.createDataFrame([(i, t, "en" if i != 3 else None, None if i == 4 else f"s{(i or 0) % 3}", "x", 0.5, 7, 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(awkward):
    return awkward.where("false")


def words(text):
    return WORD.findall(text or "")


# 9 and the graph


def simple_print(text, size=4):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    k = min(size, len(w))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def simple_components(prints):
    ids = sorted({(f, i) for i, f in prints})
    distinct = sorted({f for f, _ in ids})
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in range(len(distinct)):
        for b in range(a):
            if (distinct[a] ^ distinct[b]).bit_count() <= 4:
                parent[root(distinct[a])] = root(distinct[b])
    least = {}
    for f, i in ids:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return {(i, f): least.get(root(f)) for f, i in ids}


def test_simhash_is_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    expected = simple_components([(r.doc_id, simple_print(r.text)) for r in rows])
    found = {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert found == expected


def test_simhash_awkward(awkward, none):
    expected = simple_components([(r.doc_id, simple_print(r.text)) for r in awkward.collect()])
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count() and {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in rows} == expected
    assert simhash.near_duplicates(none).count() == 0 and simhash.similar(none).count() == 0
    assert {r.component_id for r in simhash.similar(awkward).where("doc_id in (4, 5)").collect()} == {4}


@pytest.mark.parametrize("shard", [4, 4096])
def test_links_are_complete(spark, shard):
    draw = random.Random(1)
    centres = [draw.getrandbits(64) for _ in range(40)]
    prints = {c ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(6))) for c in centres for _ in range(12)}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    nodes = spark.createDataFrame([(signed(p), signed(p)) for p in prints], "fingerprint long, least long")
    found = {r.node: r.label for r in graph.components(simhash.links(nodes, 4, shard)).collect()}
    groups = simple_components([(p, p) for p in prints])
    by_truth, by_found = defaultdict(set), defaultdict(set)
    for (i, _), c in groups.items():
        by_truth[c].add(i)
        by_found[found.get(signed(i), signed(i))].add(i)
    assert sorted(map(sorted, by_truth.values())) == sorted(map(sorted, by_found.values()))


def test_components_of_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    found = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 102: 100}


def test_similar_catches_near_copies(spark):
    draw = random.Random(3)
    base = [[f"w{draw.randrange(10_000)}" for _ in range(200)] for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        changed = list(w)
        for at in draw.sample(range(200), 3):
            changed[at] = "changed"
        rows.append((1000 + i, " ".join(changed)))
    found = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[1000 + i] == i for i in range(60)) >= 54 and all(found[i] == i for i in range(60))


def simple_similarity(a, b, size=5):
    sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in (words(a.lower()), words(b.lower()))]
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_similar_joins_nothing_below_the_similarity(spark):
    """Copies with more and more edits: those that join are at least 0.8 like one of their group, and all that are above 0.9 join."""
    draw = random.Random(8)
    rows, base = [], [[f"w{draw.randrange(5_000)}" for _ in range(150)] for _ in range(30)]
    for i, w in enumerate(base):
        for c in range(9):
            changed = list(w)
            for at in draw.sample(range(150), c):
                changed[at] = "changed"
            rows.append((100 * i + c, " ".join(changed)))
    text = dict(rows)
    found = defaultdict(set)
    for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r.component_id].add(r.doc_id)
    for group in found.values():
        assert len({i // 100 for i in group}) == 1
        for i in group:
            assert len(group) == 1 or max(simple_similarity(text[i], text[j]) for j in group if j != i) >= 0.8
    close = [i for i in text if i % 100 and simple_similarity(text[i], text[i - i % 100]) > 0.9]
    by = {i: c for c, group in found.items() for i in group}
    assert len(close) > 30 and sum(by[i] == by[i - i % 100] for i in close) > 0.98 * len(close)


def plain_groups(text, similarity=0.8):
    """Components of all pairs at the similarity, by the sets of all texts, and these pairs."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t.lower())) else set() for i, t in text.items()}
    held, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            held[g].append(i)
    for group in held.values():
        common.update((a, b) for n, b in enumerate(group) for a in group[:n])
    pairs = [p for p, c in common.items() if c >= similarity * (len(sets[p[0]]) + len(sets[p[1]]) - c)]
    label = {i: i for i in text}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {i: root(i) for i in text}, pairs


@pytest.mark.parametrize("shard", [20, 4096])
def test_similar_is_brute_force(spark, shard):
    """Families of texts edited little by little, most pairs of which lie around the similarity; small shards take more leaders and cells."""
    draw = random.Random(12)
    text = {}
    for family in range(40):
        w = [f"w{draw.randrange(3_000)}" for _ in range(draw.choice([12, 40, 150, 400]))]
        for c in range(25):
            changed = list(w)
            for at in draw.sample(range(len(w)), draw.randrange(0, max(2, len(w) // 22))):
                changed[at] = f"v{draw.randrange(50)}"
            text[100 * family + c] = " ".join(changed)
    truth, pairs = plain_groups(text)
    found = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(list(text.items()), "doc_id long, text string"), shard=shard).collect()}
    near = [(a, b) for a, b in pairs if text[a] != text[b]]
    assert len(near) > 1500 and sum(found[a] == found[b] for a, b in near) >= 0.98 * len(near)
    assert all(truth[i] == truth[c] for i, c in found.items())


def test_similar_on_the_given_documents(spark, docs):
    text = {r.doc_id: r.text for r in docs.where("text is not null").select("doc_id", "text").collect()}
    truth, pairs = plain_groups(text)
    found = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    assert sum(found[a] == found[b] for a, b in pairs) >= 0.95 * len(pairs) > 0 and all(truth[i] == truth[found[i]] for i in truth)


# 4


def simple_repeats(rows, span):
    seen, out = set(), {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - span + 1):
            key = tuple(w[a : a + span])
            if key in seen:
                gone[a : a + span] = [True] * span
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("shard", [1, 4096])
def test_substrings_are_brute_force(spark, docs, shard):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.deduplicate(docs, shard=shard).collect()}
    assert found == simple_repeats(rows, 20)


def test_substrings_random_repeats(spark):
    draw = random.Random(5)
    passages = [[draw.choice("abcdefgh") for _ in range(draw.randrange(5, 60))] for _ in range(6)]
    rows = [(i, " ".join(w for _ in range(4) for w in draw.choice(passages)[draw.randrange(3) :] + [f"u{draw.random()}"])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.deduplicate(df, shard=8).collect()}
    assert found == simple_repeats(rows, 20)


def test_substrings_awkward(awkward, none):
    rows = substrings.deduplicate(awkward, texts=True).collect()
    assert len(rows) == awkward.count() and substrings.deduplicate(none).count() == 0
    by = {(r.doc_id, r.n_words): r for r in rows}
    assert by[(1, 0)].n_removed == 0 and by[(8, 60_000)].n_removed == 60_000 and by[(8, 60_000)].kept == ""
    assert by[(7, 60_000)].n_removed == 55_000 and by[(11, 90)].n_removed == 87


def test_automaton_matches(spark):
    text, other = [1, 2, 3, 1, 2, 4, 2, 3], [9, 1, 2, 3, 1, 5, 2, 4]
    a = substrings.SuffixAutomaton()
    a.add(text)
    a.add([5, 2, 4, 4])
    grams = {tuple(s[i:j]) for s in (text, [5, 2, 4, 4]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    expected = [max((n for n in range(e + 1) if tuple(other[e + 1 - n : e + 1]) in grams or not n), default=0) if True else 0 for e in range(len(other))]
    expected = [max(n for n in range(e + 2) if not n or tuple(other[e + 1 - n : e + 1]) in grams) for e in range(len(other))]
    assert a.matching(other) == expected


# 10


def simple_lines(rows, run):
    seen, out = set(), {}
    for i, t in rows:
        ls = t.split("\n")
        gone = [False] * len(ls)
        for a in range(len(ls) - run + 1):
            key = tuple(ls[a : a + run])
            if key in seen:
                gone[a : a + run] = [True] * run
            seen.add(key)
        kept = [x for x, g in zip(ls, gone) if not g]
        out[i] = (len(ls), sum(gone), "\n".join(kept) if kept else None)
    return out


@pytest.mark.parametrize("run", [1, 2, 3, 5, 7])
def test_lines_are_brute_force(spark, docs, run):
    draw = random.Random(run)
    rows = sorted((r.doc_id, r.text) for r in docs.collect()) + [(10_000 + i, "\n".join(draw.choice("abc") for _ in range(draw.randrange(1, 12)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in lines.deduplicate(df, run).collect()} == simple_lines(rows, run)


def test_lines_of_a_null_id_and_of_the_id_null(spark):
    """A text under no id and the same under the id ``null`` are two documents, of which the first stays."""
    t = "one line\nanother line\na third"
    rows = [("null", t), (None, t), ("z", "before\n" + t)]
    out = {r.doc_id: r for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert out[None].kept == t and out["null"].kept is None and out["z"].kept == "before"
    assert [out[i].n_removed for i in (None, "null", "z")] == [0, 3, 3]


def test_lines_of_long_repeats(spark):
    """Blocks of 50 lines and whole documents that repeat, and the maximal runs that doubling finds in them."""
    block, other = [f"line {i}" for i in range(50)], [f"other {i}" for i in range(130)]
    texts = [["a", *block, "b"], [*block, "c", *block], ["d", *other], ["e", *block[10:40], *other[:99]], ["f"] * 9, [*other, "g"]]
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for run in (2, 3, 7):
        assert {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in lines.deduplicate(df, run).collect()} == simple_lines(rows, run)
    found = lines.repeated_runs(df.selectExpr("doc_id AS id", "xxhash64(text) AS no", "split(text, '\n') AS lines"), 2).collect()
    assert sorted((r.id, r.start, r.end) for r in found) == [(1, 0, 50), (1, 51, 101), (3, 1, 130), (4, 1, 9), (5, 0, 130)]


def test_lines_awkward(awkward, none):
    rows = lines.deduplicate(awkward, 1).collect()
    assert len(rows) == awkward.count() and lines.deduplicate(none).count() == 0
    by = {(r.doc_id, r.n_lines): r for r in rows}
    assert by[(1, 0)].kept is None and by[(8, 1)].n_removed == 1 and by[(5, 1)].n_removed == 1 and by[(4, 1)].kept == "one"


# 1


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}<script>var a='</p><p>no';</script></head><body>{body}"


CASES = [
    (None, ""), ("", ""), ("plain words", "plain words"),
    (page("<nav><ul><li><a href=x>Menu</a></li></ul></nav><div class='ad'>Buy</div><article><h1>Head</h1><p><b>One</b> two&nbsp;&amp;<br>three<p>four\n five</article><footer>&copy; x</footer>"), "Head One two & three four five"),
    (page("<article><p>a<script>x</script>b</p><aside>no</aside><div class='comments'>no</div><form>no<input></form><p>c</p></article>"), "ab a c".replace("ab a c", "ab c")),
    (page("<div class='cookie-notice'>We use cookies</div><div class='menu'><a href=/>Home</a></div><div class='content has-sidebar'><p>" + "long text " * 30 + "</p><p>more of it here, too</p></div><div id='sidebar'>side</div>"), ("long text " * 30).strip() + " more of it here, too"),
    (page("<main><p>caf&eacute; &#x41;</p></main><p>out</p>"), "café A"),
    (page("<article><p>x <!-- no --> y</p>"), "x y"),
]


@pytest.mark.parametrize("source,text", CASES)
def test_main_text(source, text):
    assert html.main_text(source) == text


@pytest.mark.parametrize("source,text", [
    ("<article><p class='notice'>We moved<p>real text<p>more</article>", "real text more"),
    ("<article><p class='notice'>We <b>moved<div>real</div><p>text</article>", "real text"),
    ("<article><p class='notice'>We moved<hr>real</article>", "real"),
    ("<article><div><p class='ad'>Buy</div>real text</article>", "real text"),
    ("<article><ul><li class='ad'>Buy<ul><li>this<li>that</ul><p>now<li>one<li>two</ul><p>more</article>", "one two more"),
    ("<article><ul><li>one<li class='ad'>Buy</ul>more</article>", "one more"),
    ("<article><dl><dt class='ad'>Buy<dd>one<dt>two</dl></article>", "one two"),
    ("<article><table><tr><td class='ad'>Buy<table><tr><td>x<td>y</table><td>one<tr class='ad'><td>Buy<td>it<tr><td>two</table></article>", "one two"),
    ("<article><p>one<div class='ad'>Buy<p>it</article><footer>no</footer>", "one"),
    ("<article><p>one<form>Buy<input><p>it</article><article><p>two</article>", "one two"),
])
def test_marked_elements_without_end_tags(source, text):
    assert html.main_text(source) == text


def simple_blocks(blocks, window=3, threshold=86):
    """The line-block distribution over (text, characters that count) of an unmarked page, by its definition."""
    n, sums = len(blocks), {}
    for start in range(-window + 1, n):
        sums[start] = sum(blocks[i][1] for i in range(max(0, start), min(n, start + window)))
    least = min(threshold, max(sums.values()) / 2)
    kept = {i for i in range(n) if blocks[i][1] and any(sums[s] >= least for s in range(i - window + 1, i + 1))}
    for a in sorted(kept):
        b = min([i for i in kept if i > a], default=a)
        if b > a + 1 and all(blocks[i][0] for i in range(a, b + 1)) and all(sums[s] > 0 for s in range(a, b - window + 2)):
            kept |= set(range(a, b))
    return " ".join(blocks[i][0] for i in sorted(kept))


def test_unmarked_pages_are_the_distribution():
    draw = random.Random(7)
    for _ in range(300):
        blocks, source = [], []
        for _ in range(draw.randrange(1, 30)):
            text = " ".join(draw.choice(["one", "two", "three"]) for _ in range(draw.choice([1, 2, 3, 12, 40])))
            kind = draw.randrange(6)
            if kind == 0:
                source.append(f"<div><a href='x>y'>{text}</a></div>")
                blocks.append((text, 0))
            elif kind == 1:
                source.append(f"<nav><p>{text}</nav>")
                blocks.append(("", 0))
            else:
                source.append(draw.choice([f"<p>{text}", f"<div><b>{text}</b></div>", f"<h2>{text}</h2>", f"<ul><li>{text}</ul>"]))
                blocks.append((text, len(text)))
        assert html.main_text("<body>" + "".join(source)) == simple_blocks(blocks), source


@pytest.mark.parametrize("source,text", [
    ("<nav>Home<p>" + "long text " * 20 + "<p>more", "long text " * 19 + "long text more"),
    ("<article><p class='social-history'>one<p class='share-price'>two<p class='share-buttons'>no<p class='cookie-notice'>no<p>three</article>", "one two three"),
    ("<article><p>one</article><article class='comment'><p>no</article><article class='related post'>no</article>", "one"),
    ("<article class='comment'><p>one</article>", "one"),
    ("<article><header><h1>no</h1></header><p>one</article>", "one"),
    ("<article><p>one</article><p>" + "not so short " * 9, "one"),
    ("<article><p>one</article><p>" + "very long passage " * 60, "one " + ("very long passage " * 60).strip()),
    ("<article><p>one <a href=\"x\">two</a> < three <4 & four</article>", "one two < three <4 & four"),
    ("<article><p title='unclosed>one</p><p>two</article>", "one two"),
])
def test_broken_and_ambiguous_pages(source, text):
    assert html.main_text(source) == text


@pytest.mark.parametrize("piece", ["<a ", "<a href=\"", "<a =\">", "<nav>", "<nav><p>x", "<p class='ad'>", "<li><div>", "<!--", "<title>", "<div><article></div>", "</div><section>", "<b></i>"])
def test_scanning_is_linear(piece):
    import time

    began = time.time()
    html.main_text("<div><article>" + piece * ((1 << 20) // len(piece)))
    assert time.time() - began < 20
    if piece == "<a ":
        assert time.time() - began < 1


def test_extract_pages(spark, sf):
    """Every article of the pages table: what stands in it, tags dropped."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r.page_id: r for r in html.extract(pages).collect()}
    from html import unescape

    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert found[r.page_id].text == " ".join(b for b in blocks if b) and found[r.page_id].n_chars == len(found[r.page_id].text)
    assert html.extract(pages.where("false")).count() == 0


# 2


def test_language_held_out(docs):
    rows = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows} == {True}
    asked = [r for r in rows if r.held_out and len(words(r.text)) > 5]
    assert sum(r.lang_pred == r.lang for r in asked) / len(asked) > 0.95
    assert all(0 <= r.score <= 1 for r in rows) and not any(r.rejected for r in rows if len(words(r.text)) > 5)


#: Languages that no training row has, code and noise.
FOREIGN = [
    "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita. Ahi quanto a dir qual era è cosa dura questa selva selvaggia e aspra e forte che nel pensier rinova la paura",
    "Litwo ojczyzno moja ty jesteś jak zdrowie ile cię trzeba cenić ten tylko się dowie kto cię stracił dziś piękność twą w całej ozdobie widzę i opisuję bo tęsknię po tobie",
    "Mieleni minun tekevi aivoni ajattelevi lähteäni laulamahan saa'ani sanelemahan sukuvirttä suoltamahan lajivirttä laulamahan",
    "Bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler",
    "Все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью",
    "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
    "def main(argv):\n    for i in range(len(argv)): print(argv[i].strip().split(','))\n    return {k: v for k, v in zip(keys, vals) if v is not None}\nint x = fgetc(stdin); while (x != EOF) { putchar(x); }",
    "qxzjk vwqxz kvjqx zzqkv jxwqk vzqjx kqwvz xjqkz " * 4,
    "aaaa " * 100,
]


def test_language_rejects_the_unknown(spark, docs):
    """Other languages, code and noise go; of held-out documents none of more than five words does."""
    model = langid.fit(docs.where(~langid.held_out()))
    odd = langid.predict(spark.createDataFrame([(t,) for t in FOREIGN], "text string"), model).collect()
    assert all(r.rejected for r in odd), [r.text[:20] for r in odd if not r.rejected]
    own = langid.predict(docs.where(langid.held_out()), model).collect()
    assert len(own) > 20 and not any(r.rejected for r in own if len(words(r.text)) > 5)


def test_language_awkward(awkward, none, docs):
    rows = langid.identify(awkward).collect()
    assert len(rows) == awkward.count() and langid.identify(none).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[1].lang_pred == by[2].lang_pred == by[9].lang_pred == "und" and by[1].score == 0 and by[9].rejected
    model = langid.fit(docs)
    odd = langid.predict(awkward.sparkSession.createDataFrame([("Это русский текст о погоде",), ("ενα κειμενο",)], "text string"), model).collect()
    assert all(r.rejected for r in odd)


# 3


def test_mix_targets(spark, docs):
    rows = mixing.plan(docs).collect()
    total = sum(r.size for r in rows)
    by = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        by[r.source][0] += r.size
        by[r.source][1] += r.taken
        by[r.source][2] = r.target
        assert r.size == len(words(r.text)) and r.taken <= 2 * r.size
    assert abs(sum(t for _, _, t in by.values()) - 1.5 * total) < 1
    for size, taken, target in by.values():
        assert abs(taken - target) <= 1 and target <= 2 * size
    free = {s: t for s, (n, _, t) in by.items() if t < 2 * n - 1e-6}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(by))}
    levels = {round(t / weight[s], 6) for s, t in free.items()}
    assert len(levels) == 1
    assert Counter(mixing.mix(docs).groupBy("doc_id").count().toPandas()["count"]).keys() <= {1, 2}


def test_mix_awkward(awkward, none):
    rows = mixing.plan(awkward).collect()
    assert len(rows) == awkward.count() and mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0
    again = mixing.plan(awkward.repartition(9)).collect()
    key = lambda rs: sorted((r.doc_id or -1, r.size, r.target, r.taken) for r in rs)
    assert key(rows) == key(again) and mixing.mix(awkward).columns == awkward.columns


# 5


def simple_edit(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_edit_distance():
    draw = np.random.default_rng(2)
    items, texts = draw.integers(1, 5, (40, 9)).astype(np.uint64), draw.integers(1, 5, (40, 14)).astype(np.uint64)
    n = draw.integers(1, 10, 40)
    assert decontaminate.edit_distance(items, n, texts).tolist() == [simple_edit(i[:k].tolist(), t.tolist()) for i, k, t in zip(items, n, texts)]


def test_leaks_recall_and_precision(spark):
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(8, 60)))) for i in range(60)]
    rows, truth = [], set()
    for d in range(400):
        text = [draw.choice(vocabulary) for _ in range(150)]
        if d < 240:
            i, item = items[d % 60]
            w = item.split()
            for _ in range(draw.randrange(int(0.2 * len(w)) + 1)):
                at = draw.randrange(len(w))
                w[at : at + 1] = draw.choice(([], ["new"], ["new", w[at]]))
            at = draw.randrange(150)
            text[at:at] = w
        rows.append((d, " ".join(text).capitalize() + "!"))
    tokens = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    for d, t in rows:
        for i, item in items:
            w = item.split()
            if simple_edit(w, tokens(t)) <= int(0.2 * len(w) + 1e-9):
                truth.add((d, i))
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found <= truth and len(found) >= 0.95 * len(truth) and len(truth) > 150


def test_leaks_beside_a_very_long_item(spark):
    """Items of all lengths in one shard; each stands once in a document of its own, one in ten of its words replaced."""
    draw = random.Random(6)
    items = [(n, " ".join(f"w{draw.randrange(3000)}" for _ in range(n))) for n in (5, 6, 9, 20, 60, 300, 4000)]
    rows = []
    for n, t in items:
        w = t.split()
        for at in draw.sample(range(n), n // 10):
            w[at] = "other"
        rows.append((n, " ".join([f"u{draw.randrange(3000)}" for _ in range(80)] + w)))
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(n, n) for n, _ in items} and all(r.edits <= r.item_words // 10 for r in found)


def test_leaks_awkward(spark, awkward, none, sf):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, "w1 w2 w3 w4 w5 w6"), (4, "w1 w2 w3 w4 w5 w6")], "item_id long, text string")
    found = decontaminate.leaks(awkward, benchmark).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in found} == {(7, 4, 0), (8, 4, 0)}
    assert decontaminate.leaks(none, benchmark).count() == 0 and decontaminate.leaks(awkward, benchmark.where("false")).count() == 0
    assert decontaminate.clean(awkward, benchmark).count() == awkward.count() - 2


# 6


def test_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.COM/x"), (2, "http://example.com/en/1?q#f"), (3, "http://www.example.com/en/1"), (4, "https://x.net/es/"), (5, "http://x.net/de/"), (6, None), (7, "no scheme"), (8, "http://com"), (9, "http://notexample.com/en/"), (9, "http://notexample.com/en/")], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = urls.judge(pages, labels, queries.RULES).collect()
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == 10 and found == {
        1: ("a.com", "/x", "com/", "allow"), 2: ("example.com", "/en/1", "example.com/en/", "block"), 3: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 4: ("x.net", "/es/", "net/es/", "block"),
        5: ("x.net", "/de/", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("com", "", None, "allow"), 9: ("notexample.com", "/en/", "com/", "allow")}
    assert urls.judge(pages.where("false"), labels, queries.RULES).count() == 0


def test_template_tree_finds_a_bad_branch(spark):
    rows = [(i, f"http://h.org/{'spam' if i % 2 else 'news'}/{i}.html") for i in range(400)] + [(1000 + i, f"http://g.org/a/b/c/d/e/f/g/h/{i}") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, int(i % 2 and i % 10 != 1)) for i in range(0, 400, 3)], "doc_id long, quality int, toxic int")
    found = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), labels, []).collect()
    verdicts = Counter((r.template, r.verdict) for r in found if r.host == "h.org")
    assert verdicts == {("/spam/*.html", "block"): 200, ("/news/*.html", "allow"): 200}
    assert len({r.template for r in found if r.host == "g.org"}) == 1


def simple_judge(pages, labels, rules, children=16, share=0.1, depth=6, z=1.96):
    """Host, path, rule, verdict and template of (page_id, url) with labels {id: is bad}, level by level in plain loops."""
    split = {i: (m[1].lower(), m[2]) if (m := re.search("://([^/?#]*)([^?#]*)", u or "")) else ("", "") for i, u in pages}
    urls = defaultdict(lambda: [0, 0, 0])
    for i, u in split.items():
        urls[u][0] += 1
        if i in labels:
            urls[u][1 + labels[i]] += 1
    segments = {u: re.sub("^/", "", u[1]).split("/")[: depth + 1] for u in urls}
    template = {u: "" for u in urls}
    for level in range(depth):
        branches = defaultdict(lambda: [0, 0, 0])
        for u, c in urls.items():
            if level < len(segments[u]):
                branches[(u[0], template[u], segments[u][level])] = [a + b for a, b in zip(branches[(u[0], template[u], segments[u][level])], c)]
        nodes = defaultdict(list)
        for (host, t, _), c in branches.items():
            nodes[(host, t)].append(c)
        new = {}
        for u in urls:
            if level >= len(segments[u]):
                continue
            segment = segments[u][level]
            n, good, bad = branches[(u[0], template[u], segment)]
            siblings = nodes[(u[0], template[u])]
            all_n, all_good, all_bad = (sum(c[j] for c in siblings) for j in range(3))
            own, rest = good + bad, all_good + all_bad - good - bad
            apart = False
            if own and rest:
                pooled = all_bad / (own + rest)
                apart = abs(bad / own - (all_bad - bad) / rest) > z * (pooled * (1 - pooled) * (1 / own + 1 / rest)) ** 0.5
            if len(siblings) > children and n < share * all_n:
                name = "*" + (m[0] if (m := re.search(r"\.[A-Za-z]{1,5}$", segment)) else "")
            else:
                name = segment if len(siblings) == 1 or apart else "~"
            new[u] = template[u] + "/" + name
        template.update(new)
    template = {u: t + "/**" * (len(segments[u]) > depth) for u, t in template.items()}
    parts, hosts = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for u, (_, good, bad) in urls.items():
        for of in (parts[(u[0], template[u])], hosts[u[0]]):
            of[0] += good
            of[1] += good + bad
    total = [sum(h[j] for h in hosts.values()) for j in (0, 1)]

    def worth(rows):
        rows = [r for r in rows if r[1]]
        n = sum(r[1] for r in rows)
        chance = sum(r[1] * (r[2] / r[3]) * (1 - r[2] / r[3]) for r in rows)
        free = sum(1 - r[1] / r[3] for r in rows)
        size = sum(r[1] - r[1] ** 2 / r[3] for r in rows)
        if not n or not chance or free < 1e-9 or size <= free:
            return 10.0
        r = (sum(r[1] * (r[0] / r[1] - r[2] / r[3]) ** 2 for r in rows) / free / (chance / n) - 1) / (size / free - 1)
        return min(10.0, max(1.0, 1 / r - 1)) if r > 0 else 10.0

    weight, host_weight = worth([(*c, *hosts[h]) for (h, _), c in parts.items()]), worth([(*c, *total) for c in hosts.values()])
    out = {}
    for i, u in split.items():
        fits = [(h + p, v) for h, p, v in rules if (u[0] == h or u[0].endswith("." + h)) and u[1].startswith(p)]
        prior = total[0] / total[1] if total[1] else 1.0
        host = (hosts[u[0]][0] + host_weight * prior) / (hosts[u[0]][1] + host_weight)
        pure = (parts[(u[0], template[u])][0] + weight * host) / (parts[(u[0], template[u])][1] + weight)
        rule = max(fits, key=lambda f: len(f[0])) if fits else (None, "block" if pure < 0.5 else "allow")
        out[i] = (*u, rule[0], rule[1], template[u], round(pure, 9))
    return out


def test_urls_are_brute_force(spark, sf):
    """Every page of the table, and a host of 300 rows in which one branch has ten labels, all bad."""
    draw = random.Random(9)
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    pages += [(10_000 + i, f"http://big.org/{'bad' if i < 10 else draw.choice(['a', 'b', 'c'])}/{draw.randrange(90)}/x{i % 7}.php?q={i}") for i in range(300)] + [(20_000, None), (20_001, "x"), (20_002, "a://B.com:8/")]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()] + [(10_000 + i, 1, int(i < 10 or i % 9 == 0)) for i in range(0, 300)]
    bad = {i: int(q == 0 or t == 1) for i, q, t in labels}
    found = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), queries.RULES).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9)) for r in found} == simple_judge(pages, bad, queries.RULES)
    assert {r.verdict for r in found if 10_000 <= r.page_id < 10_010} == {"block"} and {r.verdict for r in found if 10_010 <= r.page_id < 20_000} == {"allow"}


# 7


def test_neighbours_recall(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in vectors.collect())
    x, ids = np.array([r[1] for r in rows], np.float64), np.array([r[0] for r in rows])
    found = neighbours.search(vectors, every=10, short=40, block=97).collect()
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append((r.vec_id, r.score))
    hit = total = 0
    for q in ids[ids % 10 == 0]:
        far = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        far[ids == q] = np.inf
        best = np.lexsort((ids, far))[:10]
        hit += len({int(ids[b]) for b in best} & {v for v, _ in by[q]})
        total += 10
        assert all(abs(s - far[ids == v][0]) < 1e-9 for v, s in by[q]) and [s for _, s in by[q]] == sorted(s for _, s in by[q])
    assert hit / total >= 0.9


def test_neighbours_by_centres(spark, sf):
    """Many small centres, cut into blocks and rounds, over vectors in double precision: recall against brute force, exact scores."""
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    x, ids = np.array([r[1] for r in rows], np.float64) + 1e-9, np.array([r[0] for r in rows])
    df = spark.createDataFrame(list(zip(ids.tolist(), x.tolist())), "vec_id long, embedding array<double>")
    hit = total = 0
    found = defaultdict(list)
    for r in sorted(neighbours.search(df, every=10, leaf=25, block=20, queries=3, sample=300).collect(), key=lambda r: r.rank):
        found[r.query_id].append((r.vec_id, r.score))
    for q in ids[ids % 10 == 0]:
        far = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        far[ids == q] = np.inf
        hit += len(set(ids[np.lexsort((ids, far))[:10]].tolist()) & {v for v, _ in found[q]})
        total += 10
        assert all(s == far[ids == v][0] for v, s in found[q])
    assert hit / total >= 0.9


def test_neighbours_of_a_tight_group_are_exact(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(3000, 15)).astype(np.float32)
    x[::3] = x[0] + draw.normal(size=(1000, 15)).astype(np.float32) * 1e-3
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    found = defaultdict(list)
    for r in sorted(neighbours.search(df, every=50, short=20).collect(), key=lambda r: r.rank):
        found[r.query_id].append(r.vec_id)
    for q in range(0, 3000, 50):
        far = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        far[q] = np.inf
        assert found[q] == np.lexsort((np.arange(3000), far))[:10].tolist()


def test_neighbours_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [0.0, 1.0]), (100, [5.0, 5.0, 5.0]), (None, [1.0, 1.0]), (9, [1.0, 0.0])]
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in sorted(found, key=lambda r: r.rank)] == [(0, 1, 1, 0.0), (0, 2, 9, 0.0), (0, 3, 8, round(2**0.5, 6))]
    ties = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<float>")
    got = neighbours.search(ties, short=20, block=64).where("query_id = 200").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(10))
    assert neighbours.search(ties.where("false")).count() == 0


# 8


def check_shards(rows, source):
    assert len(rows) == len(source)
    groups, slots, sizes = defaultdict(set), defaultdict(list), Counter()
    texts = defaultdict(list)
    for r in source:
        texts[r.doc_id].append(r.text)
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        groups[(r.text_crc32, r.size)].add(r.shard)
        assert r.size in {len((t or "").encode()) + 1 for t in texts[r.doc_id]}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in groups.values())
    return sizes


def test_shards_are_even(spark, docs):
    many = docs.crossJoin(spark.range(12).withColumnRenamed("id", "k")).selectExpr("doc_id * 100 + k AS doc_id", "concat(text, k) AS text")
    sizes = check_shards(sharding.assign(many).collect(), many.collect())
    assert len(sizes) == 16 and max(sizes.values()) < 1.02 * min(sizes.values())


def test_shards_awkward(awkward, none):
    rows = sharding.assign(awkward).collect()
    check_shards(rows, awkward.collect())
    assert sharding.assign(none).count() == 0 and {r.law for r in rows} == {"bytes"} and all(0 <= r.shard < 16 for r in rows)
    small = sharding.assign(awkward, shards=None, capacity=400_000).collect()
    assert max(r.shard for r in small) == 1


def test_best_fit_decreasing():
    assert sharding.best_fit_decreasing([(7, "a"), (6, "b"), (4, "c"), (3, "d"), (12, "e")], 10) == {"e": 0, "a": 1, "b": 2, "c": 2, "d": 1}


# queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    a, b = queries.queries()[name](spark, sf).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert a.astype(object).where(a.notna(), None).equals(b.astype(object).where(b.notna(), None))


def test_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
