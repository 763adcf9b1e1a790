"""The ten operators against brute force, exact round trips and held-out accuracy, and on odd input."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from kelpie.llm import chat, decontaminate, gbdt, html_text, language_model, packing, page_maker, quality, simhash, substrings, toxicity, warc
from pyspark.sql import functions as F

R = random.Random(5)


@pytest.fixture(autouse=True)
def seeded(request):
    """Every test draws the same data whichever tests ran before."""
    R.seed(zlib.crc32(request.node.name.encode()))


VOCABULARY = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(400)]


def sentence(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n)).capitalize() + "."


def text(sentences, n=9):
    return " ".join(sentence(R.randint(n - 4, n + 4)) for _ in range(sentences))


ODD = [None, "", " \t\n ", "One", "One", "é ü 日本", "a\x00b \x1c c", "A b C d " * 3000]


def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(None if k == 2 else min(k, 4), t, 1, "x", 2.0) for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, key string, words double")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


# 1


def test_html_layouts():
    model, wrong = html_text.trained(), 0
    for html, main in page_maker.pages(120, 4242):
        nodes = html_text.parse(html)
        keep, y = html_text.decode(nodes, model.logits(html_text.features(nodes))), html_text.labels(nodes, main)
        keep[0] = y[0]
        wrong += bool((keep != y).any())
        assert all(keep[n.parent] for n, k in zip(nodes, keep, strict=True) if k and n.parent > 0)
    assert wrong <= 12


def test_html_page():
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/a>Menu</a></li><li><a href=/b>More</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div>"
        "<article><h1>A &amp; B</h1><p><b>First   line<br>goes&nbsp;on\n here, &lt;really&gt;.<p>Short.</p><div class=ad>Buy this now</div><p>The last paragraph of it, as long as the first one was.</p></article>"
        "<section id='comments'><h2>Comments</h2><p>I liked this article very much, thank you.</p></section><footer>&copy; x</footer>"
    )
    (got,) = html_text.extract([page], html_text.trained())
    assert got == "A & B\nFirst line goes on here, <really>.\nShort.\nThe last paragraph of it, as long as the first one was."


def test_html_dropped_elements():
    model, lines = html_text.trained(), [f"The {k} paragraph of it, which is as long as any other one was here." for k in ("first", "second", "third", "last")]
    page = lambda s: f"<html><body><article><p>{lines[0]}</p>{s}" + "".join(f"<p>{x}</p>" for x in lines[1:]) + "</article></body></html>"
    closed = ["<svg viewBox='0 0 1 1'/>", "<iframe src='x' />", "<svg><title>T</title><path d='x'/><text>Icon</text></svg>", "<button class=ad><div>Buy</div></button>", "<select><option>A<option>B</select>", "<noscript><p>No</p><svg/></noscript>"]
    for s in ["", *closed]:
        assert list(html_text.extract([page(s)], model)) == ["\n".join(lines)]
    for tag in sorted(html_text.DROPPED):
        (got,) = html_text.extract([page(f"<{tag}>")], model)
        assert all(x in got for x in lines)
        # and one after it that is closed
        assert all(any(x in p for n in html_text.parse(page(f"<{tag}>") + f"<{tag}>Gone</{tag}>") for p in n.parts if isinstance(p, str)) for x in lines)
    long = "tw-x " * 200
    assert html_text.parse(f"<div class='{long}sidebar' id=comments>x</div>")[1].kinds == html_text.parse("<div class=sidebar id=comments>x</div>")[1].kinds != ()


@pytest.mark.parametrize("link", ["<a href=/about/>About</a>", "<a name=x/>", "<a href=/>Home</a>", "<a href='/x' />More</a>", "<b/>"])
@pytest.mark.parametrize("tag", ["article", "div class=article-body", "section id=content"])
def test_a_slash_closes_no_element(link, tag):
    """A link whose tag ends in a slash is no link that goes on over the rest of the page."""
    lines = ["Title of it", *(f"The {k} paragraph of it, which is as long as any other one was here, and a little more." for k in ("first", "second", "third"))]
    page = f"<html><body><nav>{link}</nav><{tag}><h1>{lines[0]}</h1>" + "".join(f"<p>{x}</p>" for x in lines[1:]) + f"</{tag.split()[0]}></body></html>"
    (got,) = html_text.extract([page], html_text.trained())
    assert got.split("\n") == lines


def test_html_odd_pages(spark):
    pages = [None, "", "no markup", "<", "<p", "<!-- open", "<script>x", "<a title='>' href=\"x>y</a>", "</b></p>", "<table><tr><td>a<td>b<tr><td>c</table>", "<p>" * 3000 + "x"]
    df = spark.createDataFrame([(k, "u", h, 3) for k, h in enumerate(pages)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_text.main_text(df).collect()}
    assert len(got) == len(pages) and got[0].text == got[1].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.main_text(df.limit(0)).count() == 0


def test_whole_pages_of_the_driver(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = gbdt.fit(x[:2000], y[:2000], trees=40)
    assert ((m.logits(x[2000:]) > 0) == y[2000:]).mean() > 0.97


# 2

TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def check_packing(pieces, docs, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, x in docs:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return sum(p.length for p in pieces) / (capacity * len(by_sequence))


def test_packing(spark):
    special = ["a  b", " a", "a \n b", "\n\n  x", "it's <|endoftext|> x", "hello <|endoftext|>", "<|endoftext|><|endoftext|> \n a", "<|endoftext |>", "x" * 5000, "  ", "a\t b", "日本 語   x", "a \x85 b", "\x1c a\x1c b", None, ""]
    docs = [*enumerate(special), *((100 + k, text(R.randint(1, 60))) for k in range(400)), (999, text(4000))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    # few windows and a small fan-in, so that leftovers are merged over more than one level
    pieces = packing.pack(df, TOKENIZER, 256, windows=8, fan_in=2).collect()
    assert check_packing(pieces, docs, 256) > 0.93
    again = packing.sequences(packing.pack(df, TOKENIZER, 256), df, TOKENIZER, 256).collect()
    assert all(len(r.ids) == 256 for r in again)


def test_packing_odd(spark):
    assert packing.pack(empty(spark), TOKENIZER).count() == 0
    got = packing.pack(odd(spark), TOKENIZER).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in got} == {None, 0, 1, 3, 4}
    named = packing.pack(spark.createDataFrame([("a", "x y"), (None, None)], "doc_id string, text string"), TOKENIZER).collect()
    assert {(r.doc_id, r.length) for r in named} == {("a", 3), (None, 1)}
    assert packing.Encoder(__import__("public_tokenizers").path("word_bpe_49k.json")).encode("Hello  world")


# 3


def brute_overlap(a, b, window=13, share=0.8):
    """Whether some diagonal has a stretch of window tokens that agrees in enough of them."""
    w = min(window, len(b))
    need = math.ceil(w * share)
    for d in range(-len(b) + 1, len(a)):
        same = [0 <= d + k < len(a) and a[d + k] == b[k] for k in range(len(b))]
        if any(sum(same[k : k + w]) >= need for k in range(len(b) - w + 1)):
            return True
    return False


def test_decontamination(spark):
    items = [(k, " ".join(R.choice(VOCABULARY) for _ in range((5, 7, 14, 20, 40, 60)[k % 6]))) for k in range(12)] + [(50, "Too few words"), (51, None)]
    docs = []
    for k in range(60):
        words = text(20).split()
        if k % 2:
            own = items[k // 2 % 12][1].split()
            part = own[: max(13, len(own) // 2)]
            for j in R.sample(range(len(part)), k % 4 - k % 2 if len(part) < 13 else k // 8 % 4):
                part[j] = "changed"
            at = R.choice([0, 30, len(words)])
            words[at:at] = part
        docs.append((k, " ".join(words).upper() if k % 5 == 0 else ", ".join(words)))
    docs += [(60, docs[1][1]), (1, docs[1][1]), (61, None), (62, ""), (63, items[4][1] + " " + text(800))]
    items += [(70, items[4][1].upper()), (71, items[4][1])]
    d = spark.createDataFrame([(*x, 1, "w") for x in docs], "doc_id long, text string, item_id int, words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda s: "".join(c.lower() if c.isalnum() else " " for c in s or "").split()
    expected = {(i, k) for i, x in docs for k, y in items if len(norm(y)) >= 5 and brute_overlap(norm(x), norm(y))}
    assert len({i for i, _ in expected}) > 15 and {(63, 4), (63, 70), (63, 71)} <= expected
    for broadcast_bytes in (1 << 26, 0):
        assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(d, b, broadcast_bytes=broadcast_bytes).collect()} == expected
        left = {r.doc_id for r in decontaminate.remove_contaminated(d, b, broadcast_bytes=broadcast_bytes).collect()}
        assert left == {i for i, _ in docs} - {i for i, _ in expected}
    assert decontaminate.overlaps(empty(spark), b).count() == 0 and decontaminate.overlaps(d, b.limit(0)).count() == 0
    assert decontaminate.overlaps(odd(spark), b).count() == 0


def test_short_items_with_every_substitution(spark):
    """Items of each short length, with any tokens changed or cut off that the share allows, and what removal takes."""
    from itertools import combinations

    docs, items = [], []
    for n in range(5, 13):
        item = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for gone in combinations(range(n), n - math.ceil(n * 0.8)):
            docs.append((1000 * n + len(docs), "before it " + " ".join("other" if k in gone else w for k, w in enumerate(item)) + " after"))
        docs += [(1000 * n + len(docs), " ".join(item[1:])), (1000 * n + len(docs) + 1, " ".join(item[:-1]))]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()}
    assert got == {(i, i // 1000) for i, _ in docs}
    rows = [(None, items[0][1]), (None, "nothing of it is here at all"), (7, items[1][1]), (7, "nothing of it is here either"), (7, None)]
    left = decontaminate.remove_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), b).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in left))) == sorted(map(str, [rows[1], rows[3], rows[4]]))


def test_seeds_hold_within_two_substitutions():
    from itertools import combinations

    for gone in combinations(range(13), 2):
        assert any(all(not (c == "1" and o + k in gone) for k, c in enumerate(m)) for m in decontaminate.MASKS for o in range(13 - len(m) + 1))


# 4


def components_of(ids, pairs):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def plain_fingerprint(s, shingle):
    import xxhash

    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    runs = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
    values = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def test_covering_masks():
    tables = [m & (1 << 64) - 1 for m in simhash.masks(3)]
    assert len(tables) == 15
    for _ in range(3000):
        gone = sum(1 << b for b in R.sample(range(64), 3))
        assert any(m & gone == 0 for m in tables)


@pytest.mark.parametrize("block", [512, 5])
def test_linked_fingerprints(spark, block):
    base = R.getrandbits(64)
    values = {base}
    while len(values) < 150:
        x = R.choice(sorted(values)) ^ sum(1 << b for b in R.sample(range(64), R.randint(1, 5)))
        values.add(x if R.random() < 0.8 else R.getrandbits(64))
    nodes = list(enumerate(sorted(values)))
    df = spark.createDataFrame([(i, simhash.signed(x)) for i, x in nodes], "node long, fp long")
    expected = components_of([i for i, _ in nodes], [(i, j) for i, x in nodes for j, y in nodes if i < j and (x ^ y).bit_count() <= 3])
    found = {r.node: r.component for r in simhash.components(simhash.links(df, 3, block)).collect()}
    assert {i: found.get(i, i) for i, _ in nodes} == expected


def test_near_duplicates(spark):
    docs = [(k, text(30)) for k in range(40)]
    docs += [(100 + k, docs[k][1]) for k in range(5)] + [(200 + k, docs[k][1].replace(VOCABULARY[k], "changed")) for k in range(10)] + [(300, None), (301, ""), (302, "Two words")]
    df = spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id long, text string, fp int, node int")
    prints = {i: plain_fingerprint(x, 3) for i, x in docs}
    expected = components_of(prints, [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 3])
    got = simhash.near_duplicates(df, 3, 3).select("*", simhash.as_hex(F.col("fp")).alias("hex")).collect()
    assert {r.doc_id: r.component_id for r in got} == expected and all(int(r.hex, 16) == prints[r.doc_id] and len(r.hex) == 16 for r in got)


def test_chain_of_components(spark):
    ids = list(range(0, 600, 3))
    R.shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)) + [(5000, 5001)], "u long, v long")
    got = {r.node: r.component for r in simhash.components(df).collect()}
    assert {got[i] for i in ids} == {0} and got[5001] == 5000
    assert simhash.components(df.limit(0)).count() == 0


def test_similar_documents_leave_one(spark):
    docs = [(k, text(40)) for k in range(30)]
    near = []
    for k in range(10):
        words = docs[k][1].split()
        for _ in range(3):
            words[R.randrange(len(words))] = "changed"
        near.append((100 + k, " ".join(words)))
    df = spark.createDataFrame([*docs, *near, (200, docs[0][1]), (None, docs[0][1])], "doc_id long, text string").withColumn("component_id", F.lit(7))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == list(range(30))


@pytest.mark.parametrize("block", [256, 4])
def test_similar_pairs_at_the_threshold(spark, block):
    """Pairs whose changed words are new are found from a Jaccard similarity of 0.8 on, and no others."""
    docs = []
    for k in range(150):
        words = [f"{R.choice(VOCABULARY)}{R.randrange(300)}" for _ in range(R.choice([60, 100, 150, 300]))]
        other = words[:]
        for j in R.sample(range(5, len(words) - 5), max(1, len(words) // 45)):
            other[j] = f"new{k}x{j}"
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    docs += [(1000 + k, docs[0][1] + f" a{k} b{k} c{k}") for k in range(30)]
    runs = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, x in docs for w in [x.split()]}
    near = [(i, j) for i in runs for j in runs if i < j and 5 * len(runs[i] & runs[j]) >= 4 * len(runs[i] | runs[j])]
    expected = components_of(runs, near)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar(df, block=block).collect()} == expected and len(near) > 60


def test_similar_texts_meet_under_covering_masks(spark):
    """Fingerprints within the radius in one part are linked, and far ones are not; the rows of similar() come from these links."""
    base = [R.getrandbits(64) for _ in range(simhash.WORDS)]
    flip = lambda x, at: x ^ sum(1 << b for b in at)
    parts = range(0, 60, simhash.PART)
    # as many bits as are sure to meet: RADIUS in one part, one more in all others, none of it in the bits that are not searched
    sure = [flip(w, [p + b for p in parts for b in range(simhash.RADIUS + (1 if (k, p) != (0, 0) else 0))]) if k < 2 else flip(w, range(simhash.RADIUS + 1)) for k, w in enumerate(base)]
    far = [R.getrandbits(64) for _ in base]
    df = spark.createDataFrame([(k, *map(simhash.signed, x)) for k, x in enumerate((base, far, sure))], "node long, f0 long, f1 long, f2 long")
    assert [tuple(r) for r in simhash.wide_links(df).collect()] == [(0, 2)]
    own = np.sort(np.array([R.getrandbits(64) for _ in range(301)], np.uint64))
    assert simhash.wide_fingerprint(own)[0] == simhash.signed(sum(1 << b for b in range(64) if 2 * sum(int(v) >> b & 1 for v in own) > len(own)))


@pytest.mark.parametrize("least", [1 << 16, 7])
def test_wide_links_of_large_buckets(spark, least):
    some = [[R.getrandbits(64) for _ in range(simhash.WORDS)] for _ in range(4)]
    nodes = [[w ^ (1 << R.randrange(64)) for w in R.choice(some)] for _ in range(200)]
    df = spark.createDataFrame([(k, *map(simhash.signed, x)) for k, x in enumerate(nodes)], "node long, f0 long, f1 long, f2 long")
    near = [(i, j) for i, x in enumerate(nodes) for j, y in enumerate(nodes) if i < j and sum((a ^ b).bit_count() for a, b in zip(x, y, strict=True)) <= simhash.NEAR]
    found = {r.node: r.component for r in simhash.components(simhash.wide_links(df, least)).collect()}
    assert found == components_of(range(200), near)


def test_hubs_of_components(spark):
    """Nodes with very many links are looked up in a broadcast; the result is the same."""
    pairs = [(0, k) for k in range(1, 900)] + [(5000, k) for k in range(600, 1500)] + [(k, k + 1) for k in range(2000, 2050)] + [(2050, 1499)]
    R.shuffle(pairs)
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert set(got.values()) == {0} and len(got) == len({x for p in pairs for x in p})
    rows = spark.createDataFrame([(k % 3 if k < 900 else k, k) for k in range(1000)], "u long, v long")
    assert {(r.u, r.v, r.m) for r in simhash.with_least(rows, "u", "v", 1000).collect()} == {(k % 3 if k < 900 else k, k, k % 3 if k < 900 else k) for k in range(1000)}


@pytest.mark.parametrize("at_once", [1 << 20, 12, 0])
def test_components_in_one_task_or_by_stars(spark, at_once):
    """Few edges are grouped in one task, and many by stars after each task has grouped its own: the result is the same."""
    ids = R.sample(range(-(10**12), 10**12), 400)
    pairs = [tuple(R.sample(ids[:300], 2)) for _ in range(220)] + [(ids[300], x) for x in ids[300:]] + [(ids[5], None)]
    got = [tuple(r) for r in simhash.components(spark.createDataFrame(pairs * 2, "u long, v long").repartition(7), at_once=at_once).collect()]
    near = [p for p in pairs if None not in p and p[0] != p[1]]
    touched = {x for p in near for x in p}
    assert len(got) == len(touched) and dict(got) == components_of(touched, near)


def test_few_links_take_few_tasks(spark):
    """Shuffles of a small search do not multiply with the partitions: each leaves files and log entries for every one."""
    docs = [(k, text(40)) for k in range(30)]
    df = spark.createDataFrame(docs + [(100 + k, docs[k][1] + " changed") for k in range(10)], "doc_id long, text string")
    sc, wide = spark.sparkContext, {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wide}
    try:
        for k, v in wide.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few links", "")
        assert simhash.keep_one(df).count() == 30
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("few links")]
        stages = [sc.statusTracker().getStageInfo(s) for s in {s for j in jobs for s in j.stageIds}]
        assert 0 < sum(s.numCompletedTasks for s in stages if s) < 1500
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ids_have_to_be_integers(spark):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    with pytest.raises(TypeError, match="integer"):
        simhash.near_duplicates(df)


def test_near_duplicates_odd(spark):
    got = simhash.near_duplicates(odd(spark), 3).collect()
    assert len(got) == len(ODD) and simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0
    assert simhash.similar(odd(spark)).count() == len(ODD)


# 5


def test_substrings(spark):
    passage = [sentence(11) for _ in range(7)]
    docs = [(k, " ".join([text(3), *(passage if k in (3, 5, 8) else []), text(4)])) for k in range(12)]
    docs += [(20, " ".join([*passage, sentence(9), *passage])), (21, None), (22, ""), (23, "Only this. Only this. Only this.")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, covered int")
    got = {r.doc_id: r for r in substrings.removals(df).collect()}
    assert set(got) == {5, 8, 20}
    whole = dict(docs)
    for i, r in got.items():
        assert not any(s in r.text for s in passage[:-1])
        assert "".join(c for k, c in enumerate(whole[i]) if not any(x.start <= k < x.end for x in r.removed)) == r.text
    out = {r.doc_id: r.text for r in substrings.remove_repeats(df).collect()}
    assert out == {i: got[i].text if i in got else x for i, x in docs}


def plain_sentences(x, window=8):
    """Sentences as lists of lower-cased words, by the definition: one word after the other."""
    rank = lambda w: hashlib.md5(w.encode()).hexdigest()[:8]
    out = []
    for line in x.split("\n"):
        own = []
        for w in line.split():
            own.append(w)
            bare = w.rstrip("\"'”’)]")
            if bare and bare[-1] in ".!?…。！？":
                out.append(own)
                own = []
        if own:
            out.append(own)
    pieces = []
    for whole in out:
        words = [w.lower() for w in whole]
        cuts = {max(k for k in range(at, at + window) if rank(words[k]) == min(map(rank, words[at : at + window]))) for at in range(len(words) - window + 1)}
        for k, w in enumerate(words):
            if not k or k - 1 in cuts:
                pieces.append([])
            pieces[-1].append(w)
    return pieces


def plain_removals(docs, min_sentences=3, min_words=28):
    """The words each document keeps and how many sentences it loses: documents by id, spans by their words."""
    said = {}
    for k, (_, x) in enumerate(docs):
        s = plain_sentences(x or "")
        for at in range(len(s)):
            for end in range(at + min_sentences, len(s) + 1):
                if sum(map(len, s[at:end])) >= min_words:
                    said.setdefault(tuple(w for p in s[at:end] for w in p), []).append((docs[k][0], k, at, end))
                    break
    gone = {}
    for places in said.values():
        least = min(i for i, *_ in places)
        for i, k, at, end in places:
            if i > least or any(k == l and b < at for _, l, b, _ in places):
                gone.setdefault(k, set()).update(range(at, end))
    return {k: (len(g), [w for n, p in enumerate(plain_sentences(docs[k][1])) if n not in g for w in p]) for k, g in gone.items()}


def test_removals_against_brute_force(spark):
    rng = random.Random(55)
    word = lambda: rng.choice(VOCABULARY) + rng.choice(["", "", "", "", "", "", ".", "?)", ",", "\n"])
    pool = [[word() for _ in range(rng.choice([4, 25, 52, 90]))] for _ in range(14)]
    docs = []
    for k in range(60):
        words = [w for _ in range(rng.randrange(5)) for w in [*rng.choice(pool), *(word() for _ in range(rng.randrange(30)))]]
        docs.append((k // 2 if k < 20 else k, rng.choice([" ", "  ", "\t"]).join(w.upper() if rng.random() < 0.2 else w for w in words)))
    docs += [(100 + k, " ".join(pool[2] + pool[3])) for k in range(30)] + [(5, docs[10][1]), (3, ""), (4, "\n\n ")]
    expected = plain_removals(docs)
    df = spark.createDataFrame([(*d, k, 0, 0) for k, d in enumerate(docs)], "doc_id long, text string, k int, covered int, th int").repartition(7)
    got = {r.k: r.text for r in substrings.remove_repeats(df).collect()}
    assert len(expected) > 30 and len(got) == len(docs)
    for k, (_, x) in enumerate(docs):
        if k in expected:
            assert [w.lower() for w in got[k].split()] == expected[k][1]
        else:
            assert got[k] == x
    lost = Counter((r.doc_id, r.n_removed) for r in substrings.removals(df).collect())
    assert lost == Counter((docs[k][0], n) for k, (n, _) in expected.items())


def test_one_passage_in_very_many_documents_arrives_once_a_task():
    """Spans that a task holds many times are settled there: only the first goes on, and all others are covered."""
    h = np.repeat(np.array([7, 9]), 500)
    ids, of, at = np.arange(1000)[::-1] % 500, np.arange(1000), np.zeros(1000, np.int64)
    gone, left = substrings.later(h, h, ids, of, at)
    assert len(left) == 2 and sorted(ids[left]) == [0, 0] and len(gone) == 998


def test_sentences_cover_the_text():
    for x in ["", "a", "A. B! C", "one\n\ntwo. \"x.\" y", "w " * 500, "。 日本。 x", text(50)]:
        s = substrings.sentences(x)
        assert "".join(x[a:b] for a, b in s) == x and all(b > a for a, b in s)
    # a long passage without sentences is cut alike wherever it stands
    long = " ".join(R.choice(VOCABULARY) for _ in range(200))
    one, two = ({x[a:b].strip() for a, b in substrings.sentences(x)} for x in (f"zz yy {long}", f"qq {long}"))
    assert len(one & two) >= len(one) - 2 > 3


@pytest.mark.parametrize("space", [" ", "\n\t", "\u00a0"])
def test_repeated_passages_of_fifty_words_share_a_span(space):
    """Wherever they stand, with and without sentence ends, and whatever separates their words."""
    rng = random.Random(9)
    word = lambda: rng.choice(VOCABULARY) + ("." if space == " " and rng.random() < rng.choice([0, 0.08]) else "")
    for _ in range(300):
        passage = [word() for _ in range(50)]
        one, two = ({x[2:4] for x in substrings.spans(space.join([*(word() for _ in range(rng.randrange(40))), *passage, *(word() for _ in range(rng.randrange(40)))]))} for _ in range(2))
        assert one & two


def test_substrings_odd(spark):
    out = substrings.remove_repeats(odd(spark))
    assert sorted(map(str, (r.text for r in out.collect()))) == sorted(map(str, ODD)) or out.count() == len(ODD)
    assert substrings.removals(empty(spark)).count() == 0 and out.columns == odd(spark).columns


# 6


def test_chat_round_trip(spark):
    control = "<|im_end|><|im_start|>assistant ok <\\|im_end|> <\\\\|x| <|"
    rows = [(1, 0, "system", "be <kind>"), (1, 2, "assistant", control), (1, 1, "user", control), (1, 3, "assistant", None), (1, 4, "user", "bye"), (2, 0, "user", "only"), (3, 0, "we\nird\\n\x00<|", "x"), (4, None, None, "a"), (4, 0, "assistant", "b\n"), (4, 0, "assistant", "b\n"), (None, 1, "assistant", "n")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    turns = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.digest(turns).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        said, replies = "".join(f"{a}\n{b}\n" for _, a, b in own), "".join(b for _, a, b in own if a == "assistant")
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_chars == len(replies) and got[c].loss_sha256 == hashlib.sha256(replies.encode()).hexdigest()
    whole = {r.conv_id: r.transcript for r in chat.transcripts(turns).collect()}
    assert sum(len(x) for x in whole.values()) == sum(r.formatted_chars for r in got.values())
    examples = chat.render(turns).collect()
    assert len(examples) == 5
    for e in examples:
        assert whole[e.conv_id].startswith(e.context + e.target) and e.target[e.loss_start + e.loss_chars :] == "<|im_end|>\n"
        assert e.context.count(chat.START) == e.example - 1
    assert chat.digest(chat.format_turns(df.limit(0))).count() == 0


def test_chat_of_long_conversations_and_clashing_columns(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", "long " * 20_000 if k == 3 else f"turn {k}") for k in range(400)]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "conv_id long, turn long, role string, text string, ordinal int, examples string")
    (got,) = chat.digest(chat.format_turns(df)).collect()
    replies = "".join(x for _, _, role, x in rows if role == "assistant")
    assert got.n_turns == 400 and got.loss_chars == len(replies) and got.loss_sha256 == hashlib.sha256(replies.encode()).hexdigest()


def test_faults_of_the_expansion_show(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (2, 0, "user", "e")], "conv_id long, turn long, role string, text string")
    turns, whole = chat.format_turns(df), chat.expand
    assert sorted((r.conv_id, r.loss_chars) for r in chat.digest(turns).collect()) == [(1, 2), (2, 0)]
    for column, wrong in (("context_chars", F.col("context_chars") + 1), ("target", F.concat("target", F.lit("x"))), ("example", F.col("example") + 1)):
        monkeypatch.setattr(chat, "expand", lambda t, c=column, w=wrong, **k: whole(t, **k).withColumn(c, w))
        with pytest.raises(Exception, match="does not stand where its context ends"):
            chat.digest(turns).collect()
    monkeypatch.setattr(chat, "expand", lambda t, **k: whole(t, **k).withColumn("loss_chars", F.lit(0)))
    assert {r.loss_chars for r in chat.digest(turns).collect()} == {0}


def test_examples_hold_their_prefix_and_the_digest_reads_it(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d")], "conv_id long, turn long, role string, text string")
    turns, whole = chat.format_turns(df), chat.expand
    formatted = [f"<|im_start|>{role}\n{x}<|im_end|>\n" for role, x in (("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"))]
    assert sorted((r.example, r.context, r.target) for r in whole(turns).collect()) == [(2, formatted[0], formatted[1]), (4, "".join(formatted[:3]), formatted[3])]
    broken = F.when(F.col("example") == 4, F.replace("context", F.lit("a"), F.lit("x"))).otherwise(F.col("context"))
    for change in (lambda e: e.withColumn("context", broken), lambda e: e.where("example is null or example <> 2")):
        monkeypatch.setattr(chat, "expand", lambda t, c=change, **k: c(whole(t, **k)))
        with pytest.raises(Exception, match="does not stand where its context ends"):
            chat.digest(turns).collect()


# 7


def test_language_model(spark):
    docs = [(k, text(12)) for k in range(150)] + [(500, None), (501, ""), (3, text(2)), (None, "x y")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int")
    got = language_model.score(df, word_share=0.005).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, x in docs:
        if not held(i):
            counts.update((x or "").lower().encode().split())
            counts["end"] += 1
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, x in docs:
        tokens = [*(x or "").lower().encode().split(), "end"]
        expected.append((str(i), held(i), len(tokens), sum(t in counts for t in tokens), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(expected)
    assert all(r.score < 0 for r in got)
    chars = {i: len(x or "") for i, x in docs}
    out = [r for r in got if r.held_out and r.n_tokens > 20]
    # words of ten even letters: little above one digit a letter is the best there is
    assert sum(r.score for r in out) / sum(chars[r.doc_id] for r in out) > -1.05
    assert language_model.score(empty(spark)).count() == 0
    assert len(language_model.score(odd(spark)).collect()) == len(ODD)


def test_every_counted_node_is_scored(spark):
    """Which grams are broadcast and which are joined changes no score, and rare ones keep their evidence."""
    docs = [(k, text(6)) for k in range(60)] + [(70, "é 日本 unseen qqzzqq"), (71, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    body = {i: b" ".join((x or "").lower().encode().split()) for i, x in docs}
    train = [b for i, b in body.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    own = lambda b: language_model.grams(language_model.PAD + b + language_model.END)
    g = np.concatenate([own(b) for b in train])
    trie = language_model.Trie([np.unique(g & language_model.mask(k), return_counts=True) for k in range(language_model.ORDER + 1)])
    expected = {i: trie.escape(own(b)).sum() for i, b in body.items()}
    for share in (2.0**-21, 0.002, 1.0):
        assert {r.doc_id: r.score for r in language_model.score(df, node_share=share).collect()} == pytest.approx(expected, rel=1e-5)


def plain_ppm(nodes, gram):
    """log10 P by the definition, from counts of every order."""
    order, excluded, out = len(nodes) - 1, set(), 0.0
    sym = gram & 255
    for k in range(order, -1, -1):
        ctx = (gram & language_model.mask(k)) >> 8
        own = {int(key) & 255: int(c) for key, c in zip(*nodes[k], strict=True) if int(key) >> 8 == ctx}
        left = {s: c for s, c in own.items() if s not in excluded}
        if not own:
            continue
        total = 2 * sum(left.values())
        if sym in left:
            return out + math.log10((2 * left[sym] - 1) / total)
        if left:
            out += math.log10(len(left) / total)
        excluded = set(own)
    return out + math.log10(1 / (256 - len(excluded)))


@pytest.mark.parametrize("options", [{}, {"hot_grams": 40, "hot_words": 3, "shard_bytes": 2000}, {"hot_grams": 0, "hot_words": 0}])
def test_scores_against_plain_ppm(spark, options):
    """The query's score column, document by document, against the definition of PPM over counts of every order."""
    rng = random.Random(71)
    docs = [(k, " ".join(rng.choice(["Ab", "abc", "ba", "cab", "é"]) for _ in range(rng.randrange(9)))) for k in range(24)] + [(2, "Ab q"), (None, "zz"), (90, "unseen xyz"), (91, None)]
    body = [(i, b" ".join((x or "").lower().encode().split())) for i, x in docs]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    padded = lambda b: b"\n" * 6 + b + b"\n"
    counts = [Counter(padded(b)[at - k : at + 1] for i, b in body if not held(i) for at in range(6, len(b) + 7)) for k in range(7)]
    nodes = [([int.from_bytes(x, "big") for x in c], list(c.values())) for c in counts]
    plain = lambda b: sum(plain_ppm(nodes, int.from_bytes(padded(b)[at - 6 : at + 1], "big")) for at in range(6, len(b) + 7))
    expected = sorted((str(i), round(plain(b), 4)) for i, b in body)
    got = language_model.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), **options).collect()
    for (i, x), (j, y) in zip(sorted((str(r.doc_id), round(r.score, 4)) for r in got), expected, strict=True):
        assert i == j and x == pytest.approx(y, abs=2e-3)
    assert len({i for i, _ in docs if held(i)}) > 1


def test_blocks_of_numbers():
    for values in (np.zeros(0, np.int64), np.array([5]), np.sort(np.random.default_rng(1).integers(0, 1 << 56, 5000))):
        assert (language_model.unpack_sorted(language_model.pack_sorted(values)) == values).all()
    assert language_model.unpack_words(language_model.pack_words([b"a", b"\xc3\xa9"])) == [b"a", b"\xc3\xa9"] and language_model.unpack_words(language_model.pack_words([])) == []
    g = language_model.grams(language_model.PAD + b"some text of it" + language_model.END)
    assert (language_model.turn(g) == language_model.turned(language_model.PAD + b"some text of it" + language_model.END)).all() and (language_model.turn(language_model.turn(g)) == g).all()


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", None), (None, "x")], "doc_id string, text string")
    assert {r.doc_id for r in language_model.score(df).collect()} == {"a", "b", None}


def test_ppm_is_a_distribution():
    bodies = [bytes(R.choice(b"abc de") for _ in range(60)) for _ in range(20)]
    g = np.concatenate([language_model.grams(language_model.PAD + b + language_model.END) for b in bodies])
    nodes = [np.unique(g & language_model.mask(k), return_counts=True) for k in range(language_model.ORDER + 1)]
    trie = language_model.Trie(nodes)
    for ctx in (b"aabcab", b"zzzzzz", b"zzzzza", b"\n" * 6, bodies[0][3:9]):
        all_ = np.array([int.from_bytes(ctx + bytes([s]), "big") for s in range(256)])
        assert (10 ** trie.escape(all_)).sum() == pytest.approx(1, abs=1e-6)
        assert trie.escape(all_) == pytest.approx([plain_ppm(nodes, int(x)) for x in all_], abs=1e-5)


def test_grams_of_parts(monkeypatch):
    """A text longer than a piece has the grams of the whole, each once, and texts beside it keep theirs."""
    monkeypatch.setattr(language_model, "PIECE", 700)
    bodies = [b"abc", bytes(R.choice(b"abc de") for _ in range(5000)), b""]
    whole = [language_model.grams(language_model.PAD + b + language_model.END) for b in bodies]
    found = [[], [], []]
    for buffer, owners, starts in language_model.pieces(iter(enumerate(bodies))):
        g, ok = language_model.grams(buffer), language_model.valid(buffer, starts)
        for owner, begin, end in zip(owners, starts, [*starts[1:], len(g)], strict=True):
            found[owner] += g[begin:end][ok[begin:end]].tolist()
    assert found == [w.tolist() for w in whole]


# 8


def test_quality(spark):
    got = {r.doc_id: r for r in quality.ledger(spark.createDataFrame([(0, "a b c d a b c x y"), (1, "x\nx\n \n\ny # *"), (2, None), (3, "é ü")], "doc_id long, text string")).collect()}
    assert (got[0].n_words, got[0].n_repeat_words, got[0].word_chars) == (9, 6, 9)
    assert (got[1].n_dup_lines, got[1].n_lines, got[1].n_symbols) == (1, 3, 2)
    assert got[2].n_words == 0 and got[3].n_words == 1 and got[3].word_chars == 3
    for r in got.values():
        assert r.failure_bits & 1
    df = odd(spark)
    assert quality.ledger(df).count() == len(ODD) and quality.ledger(empty(spark)).count() == 0


CLASHING = "doc_id long, text string, doc string, a int, b int, m int, k int, h int, th int, covered int, salt int, class_id int, failure_bits int, n_words int, __bad int, __gone int, __id int, __key int, __th int, __measures int, `a.b` int"


def test_columns_with_clashing_names_pass_through(spark):
    benchmark = spark.createDataFrame([(1, " ".join(VOCABULARY[:20]))], "item_id long, text string")
    same = " ".join(R.choice(VOCABULARY) for _ in range(120))
    rows = [(1, same), (2, same), (3, " ".join([*VOCABULARY[:20], *(R.choice(VOCABULARY) for _ in range(80))])), (4, None), (None, same), (5, "few")]
    df = spark.createDataFrame([(i, x, *(str(k) if c == 2 else c for c in range(2, 21))) for k, (i, x) in enumerate(rows)], CLASHING)
    for operator, gone in ((quality.keep, {3, 5}), (simhash.keep_one, {1}), (substrings.remove_repeats, set()), (lambda d: decontaminate.remove_contaminated(d, benchmark), {2})):
        got = operator(df).collect()
        assert operator(df).columns == df.columns and {int(r.doc) for r in got} == set(range(len(rows))) - gone
        assert all(r["a.b"] == 20 and r["__measures"] == 19 and r.failure_bits == 12 and r["__bad"] == 14 for r in got)


def test_policies_agree_with_their_filter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bits = quality.ledger(docs)
    kept = {r.doc_id for r in bits.where(~quality.fails("v1")).collect()}
    assert {r.doc_id for r in quality.keep(docs, "v1").collect()} == kept and quality.keep(docs).columns == docs.columns
    rows = [r.failure_bits & quality.POLICIES["v1"].mask for r in bits.collect()]
    for r in quality.ablations(bits, "v1").collect():
        bit = 1 << [x.name for x in quality.RULES].index(r.rule)
        assert (r.failing, r.failing_alone, r.kept_without) == (sum(x & bit > 0 for x in rows), sum(x == bit for x in rows), sum(x in (0, bit) for x in rows))


# 9


def test_toxicity(spark):
    bad = ["vilebad" + x for x in ("", "a", "er", "ung")]
    docs, labels = [], []
    for k in range(500):
        toxic, low = k % 5 == 0, k % 7 == 0
        words = text(6).split()
        for _ in range(4 if toxic else 0):
            words.insert(R.randrange(len(words)), R.choice(bad))
        docs.append((k, " ".join(words) + (" zz zz zz" if low else "")))
        labels.append((k, int(toxic), int(low), None if k == 3 else 1))
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, p_toxic double")
    marks = spark.createDataFrame(labels[:300], "doc_id long, toxic int, low int, x int")
    model = toxicity.train(df, marks, {"low": "low", "toxic": "toxic"})
    got = {r.doc_id: r for r in toxicity.classify(df, model).collect()}
    right = sum(got[k].toxic == (k % 5 == 0) and got[k].low == (k % 7 == 0) for k in range(300, 500))
    assert right >= 196 and all(0 <= r.p_toxic <= 1 for r in got.values())
    few = toxicity.train(df, marks, {"toxic": "toxic"}, max_train=50)
    assert toxicity.classify(odd(spark), few).count() == len(ODD)
    none = toxicity.train(df, marks.limit(0), {"toxic": "toxic"})
    assert toxicity.classify(df, none).where("toxic").count() == 0 and toxicity.classify(empty(spark), none).count() == 0
    assert toxicity.train(df, marks, {"same": "1"}).models[0].weights == {}


def test_a_label_has_no_part_in_its_own_out_of_fold_probability(spark):
    docs = [(k, " ".join(R.choice(VOCABULARY[:80]) for _ in range(12))) for k in range(240)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    y = {k: int(R.random() < 0.3) for k, _ in docs}

    def held_out(labels):
        marks = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
        rows, fold, marked = toxicity.training_rows(df, marks, {"toxic": "toxic"}, 1000, 15, "doc_id", "text")
        return fold, toxicity.out_of_fold(rows, fold, marked["toxic"], np.zeros((rows.n, 0)), 15)

    fold, before = held_out(y)
    # all labels of one fold turned over
    fold_2, after = held_out({k: 1 - v if toxicity.fold_of(str(k)) == 1 else v for k, v in y.items()})
    assert (fold == fold_2).all() and np.abs(before[fold == 1] - after[fold == 1]).max() < 1e-9
    assert np.abs(before[fold != 1] - after[fold != 1]).max() > 1e-3


def plain_chain(docs, labels, most):
    """Probabilities and thresholds of a chain, with dense arrays."""
    import re

    def read(x):
        n = Counter(f for w in re.findall(r"\w+", x.lower()) for f in toxicity.word_features(w))
        return {*n, *(f + (1 << toxicity.BITS) for f, c in n.items() if c >= 3)}

    own = [read(x) for _, x in docs]
    names = sorted(set().union(*own))
    x = np.array([[f in s for f in names] for s in own], float)
    fold = np.array([zlib.crc32(str(i).encode()) % 3 for i, _ in docs])
    train = np.array([i in next(iter(labels.values())) for i, _ in docs])
    given, given_train, thresholds = np.zeros((len(docs), 0)), np.zeros((len(docs), 0)), []

    def fitted(y, extra, use):
        n, p, rate = x[use].sum(0), max(1, y[use].sum()), (x[use].sum(0) + 0.5) / (use.sum() + 1)
        z = np.where(n >= 3, np.abs((x * y[:, None])[use].sum(0) - p * rate) / np.sqrt(p * rate * (1 - rate) + 1e-9), 0)
        best = [k for k in sorted(range(len(names)), key=lambda k: (-z[k], names[k]))[:most] if z[k] > 2]
        a = np.column_stack([x[:, sorted(best)], extra, np.ones(len(x))])
        w = np.zeros(a.shape[1])
        w[-1], m, g2 = np.log(y[use].mean() / (1 - y[use].mean())), np.zeros_like(w), np.zeros_like(w)
        for t in range(1, 81):
            grad = a[use].T @ (1 / (1 + np.exp(-np.clip(a[use] @ w, -30, 30))) - y[use]) / use.sum()
            grad[:-1] += w[:-1] / use.sum()
            m, g2 = 0.9 * m + 0.1 * grad, 0.99 * g2 + 0.01 * grad**2
            w -= 0.1 * m / (1 - 0.9**t) / (np.sqrt(g2 / (1 - 0.99**t)) + 1e-8)
        return lambda e: 1 / (1 + np.exp(-np.clip(np.column_stack([x[:, sorted(best)], e, np.ones(len(x))]) @ w, -30, 30)))

    out = []
    for marks in labels.values():
        y = np.array([marks.get(i, 0) for i, _ in docs], float)
        held = np.zeros(len(docs))
        for f in range(3):
            held[fold == f] = fitted(y, given_train, train & (fold != f))(given_train)[fold == f]
        out.append(fitted(y, given_train, train)(given))
        ranked = sorted(((held[k], y[k]) for k in np.flatnonzero(train)), reverse=True)
        f1 = [2 * sum(v for _, v in ranked[: k + 1]) / (k + 1 + y[train].sum()) for k in range(len(ranked))]
        k = int(np.argmax(f1))
        thresholds.append((ranked[k][0] + (ranked[k + 1][0] if k + 1 < len(ranked) else 0)) / 2)
        given, given_train = np.column_stack([given, out[-1]]), np.column_stack([given_train, held])
    return out, thresholds


def test_toxicity_against_a_plain_chain(spark):
    docs = [(k, " ".join(R.choice(VOCABULARY[: 60 if k % 3 else 90]) for _ in range(R.randint(5, 40))) + (" awful" * (k % 5) if k % 4 == 0 else "")) for k in range(260)]
    marks = {"low": {k: int(k % 3 == 0) for k in range(200)}, "toxic": {k: int(k % 4 == 0 or R.random() < 0.05) for k in range(200)}}
    labels = spark.createDataFrame([(k, marks["low"][k], marks["toxic"][k]) for k in range(200)], "doc_id long, low int, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    expected, thresholds = plain_chain(docs, marks, 60)
    model = toxicity.train(df, labels, {"low": "low", "toxic": "toxic"}, max_features=60)
    got = {r.doc_id: r for r in toxicity.classify(df, model).collect()}
    assert model.thresholds == pytest.approx(thresholds, abs=1e-5)
    for k, (i, _) in enumerate(docs):
        assert (got[i].p_low, got[i].p_toxic) == pytest.approx((expected[0][k], expected[1][k]), abs=1e-5)


# 10


def test_warc_of_long_payloads_and_clashing_columns(spark):
    long = "<p>é" * 400_000
    df = spark.createDataFrame([(1, "u", long, "x", 1), (2, "u", long, "x", 1), (3, None, None, "x", 1), (3, "v", "other", "x", 1)], "page_id long, url string, html string, refers_to string, payload int")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(df).collect())
    assert got == [(1, 2_000_000, "response", None), (2, 2_000_000, "revisit", 1), (3, 0, "response", None), (3, 5, "response", None)]
    assert warc.record_id(3, "A") != warc.record_id(3, "B")


def test_warc(spark, tmp_path):
    pages = [(k, f"http://x/{k}\n", f"<p>{k % 4}" * (k % 4) * 50) for k in range(40)] + [(100, None, None), (0, "http://again", ""), (None, "u", "lone")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    folder = str(tmp_path / "w")
    manifest = warc.write_archives(df, folder, warc.record_types(df), file_mb=0)
    rows = warc.read_archives(manifest).collect()
    assert len(rows) == len(pages)
    first = {}
    for i, _, h in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(h or "", i)
    body = {p[0]: p[2] or "" for p in pages}
    for r in rows:
        h = body[r.page_id].encode()
        assert r.payload_bytes == len(h) and r.payload_digest == base64.b32encode(hashlib.sha1(h).digest()).decode()
        revisit = r.page_id is not None and first[body[r.page_id]] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", first[body[r.page_id]]) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == h
    # real files: concatenated members, read by an ordinary gzip reader
    import gzip
    from pathlib import Path

    files = sorted(Path(folder).glob("*.warc.gz"))
    assert len(files) == manifest.count() and sum(gzip.open(f).read().count(b"WARC/1.1\r\n") for f in files) == len(pages)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_warc_damage():
    h = warc.header(1, "u", "response", b"abc", base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), 3, None)
    assert warc.parse_record(h + b"abc\r\n\r\n")[0] == 1
    for bad in (h + b"abd\r\n\r\n", h + b"abc\r\n", h + b"abcd\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    import io

    gz = warc.member(h + b"abc\r\n\r\n", 6)
    assert len(list(warc.members(io.BytesIO(gz * 3)))) == 3
    with pytest.raises((ValueError, zlib.error)):
        list(warc.members(io.BytesIO(gz + gz[:-5])))


def test_warc_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    assert {r.page_id for r in warc.archive_round_trip(df, min_bytes=3).where("record_type = 'revisit'").collect()} == {4}
