"""Each corpus operator against brute force on small tables, and its edge cases."""

import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import components, decontam, html_region, lbl, minhash, ppm, quality, sampled_pieces, templates, textcnn, url_rules
from lodestone.llm.common import Scratch, crc_mod

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, key string"
LONG = " ".join(f"w{i}" for i in range(3000))


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def documents(spark):
    """Ordinary texts, copies, near copies, nulls, empty and very long texts, extra columns
    whose names the operators use inside."""
    rng = np.random.default_rng(1)
    vocab = {"en": "the of and to in is that for with this from are was house tree river".split(), "de": "der die und den von mit ist das nicht ein haus baum fluss über schön".split()}
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        text = "\n".join(" ".join(rng.choice(vocab[lang], 12)) + f" {i}x{j}" for j in range(4))
        rows.append((i, text, lang, "s1"))
    base = " ".join(f"t{k}" for k in range(100))
    for i in range(60, 70):
        rows.append((i, base if i % 2 else base.replace("t50", f"u{i}"), "en", "s2"))
    rows += [(70, None, "en", "s1"), (71, "", None, None), (72, "  \n\t ", "en", None), (73, LONG, "de", "s1"), (74, "one two", "en", "s1"), (75, "One  two", "en", "s1"), (76, "123 !!", None, "s1")]
    rows += [(80 + i, f"Start of text {i} alpha beta\nAll of this site is under the licence number {i} of our firm\n" + " ".join(c + chr(97 + i) * 3 for c in "bcdfghjkl"), "en", "s3") for i in range(4)]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", "y") for r in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


def test_components(spark):
    links = [(5, 4), (4, 3), (9, 8), (3, 2), (7, 7), (2, 1), (8, 9), (20, 1)] + [(100 + i, 101 + i) for i in range(30)]
    out = components.connected_components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "t"))
    found = {r["id"]: r["component"] for r in out.collect()}
    assert found == {**dict.fromkeys((1, 2, 3, 4, 5, 20), 1), 8: 8, 9: 8, **{100 + i: 100 for i in range(31)}}
    assert components.connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def test_minhash(documents, texts):
    out = minhash.near_duplicate_classes(documents)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect()} == brute_components(texts)


def test_minhash_filters_lose_no_link():
    """The signature filter fails a pair of similarity 0.75 with less than 2e-6."""
    n = minhash.BANDS * minhash.ROWS
    tail = lambda p, least: sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least, n + 1))
    assert tail(0.25, n - math.ceil(minhash.LEAST_AGREEMENT * n) + 1) < 2e-6


def test_minhash_pivots_reach_what_the_first_misses(spark, monkeypatch):
    """A chain: each text is like the next only."""
    monkeypatch.setattr(minhash, "PAIRS_A_MEMBER", 0)
    w = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(w[i * 8 : i * 8 + 100]) for i in range(20)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicate_classes(df).collect()}
    assert got == brute_components(texts)


def test_minhash_group_of_near_copies(spark):
    """Copies of one text with changes of their own: some are like the first, some like each
    other, most like none; a text of few words and null texts stand beside them."""
    rng = np.random.default_rng(3)
    base = [f"t{k}" for k in range(120)]
    texts = {0: " ".join(base), 1: None, 2: "t1 t2", 3: ""}
    for i in range(10, 130):
        w = list(base)
        for at in rng.choice(120, rng.integers(1, 9), replace=False):
            w[at] = rng.choice(["", f"n{rng.integers(4)}", f"own{i}_{at}"])
        texts[i] = " ".join(x for x in w if x)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicate_classes(df).collect()}
    want = brute_components(texts)
    assert got == want and 5 < len({c for _, c, _ in want.values()}) < 100


def test_quality(documents, texts):
    def brute(text):
        w = (text or "").encode().split()
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
        return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)

    rows = quality.quality_filter(documents).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality.COUNTS) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_fences(spark):
    """Rows far outside their group go, others stay; small groups take their language's fence."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"], 5)) + " " + " ".join(f"x{rng.integers(10**6)}" for _ in range(60)), "en", "big") for i in range(300)]
    rows += [(1000, " ".join(f"###{i}$$$" for i in range(80)), "en", "big"), (1001, rows[0][1] + " z", "en", "small")]
    out = {r["doc_id"]: r["kept"] for r in quality.quality_filter(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not out.pop(1000) and all(out.values())


def test_quality_limits_follow_exact_quantiles(spark):
    """Limits and verdicts against exact quantiles (each group is smaller than its sketch)."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join("#" * int(rng.integers(0, 3)) * (rng.random() < 0.05) + f"w{rng.integers(500)}" for _ in range(60)), str(rng.choice(["en", "de"])), str(rng.choice(["a", "b", "b"]))) for i in range(120)]
    rows += [(500, None, "en", "a"), (501, "", None, None), (502, "x " * 60, "en", "b"), (503, "####" + rows[0][1], None, None), (503, "####" + rows[0][1], None, None)]
    out = quality.quality_filter(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r[0] for r in rows)
    of = {r[0]: r[2:] for r in rows}
    good = [r for r in out if not r["base_failed"]]
    share = {id(r): r["n_symbols"] / r["word_chars"] for r in good}

    def at(values, q):  # the least value with a share of q of the values up to it
        return sorted(values)[max(0, math.ceil(q * len(values)) - 1)]

    def quantiles(rows, value):
        return [at([value(r) for r in rows], q) for q in (0.25, 0.5, 0.75)]

    def shrunk(r, value):
        own = [x for x in good if of[x["doc_id"]] == of[r["doc_id"]]]
        lang = [x for x in good if of[x["doc_id"]][0] == of[r["doc_id"]][0]]
        p, q = (len(x) / (len(x) + quality.PRIOR_ROWS) for x in (own, lang))
        return [p * a + (1 - p) * (q * b + (1 - q) * c) for a, b, c in zip(quantiles(own, value), quantiles(lang, value), quantiles(good, value), strict=True)]

    for r in good:
        q1, _, q3 = shrunk(r, lambda x: share[id(x)])
        size = shrunk(r, lambda x: x["word_chars"])[1]
        limit = q3 + quality.FENCE * (q3 - q1 + math.sqrt((q3 + 4 / size) * 4 / r["word_chars"]))
        assert r["symbol_share_max"] == pytest.approx(limit, rel=1e-6)
        if share[id(r)] > limit:
            assert not r["kept"]


def test_quality_edges(spark):
    """Empty tables, and tables of which no row passes the base rule."""
    schema = "doc_id long, text string, lang string, source string"
    assert quality.quality_filter(spark.createDataFrame([], schema)).count() == 0
    rows = quality.quality_filter(spark.createDataFrame([(1, "a b", "en", "s"), (2, None, None, None), (None, "", "en", "s")], schema)).collect()
    assert len(rows) == 3 and all(r["base_failed"] and not r["kept"] and r["symbol_share_max"] is None for r in rows)


def test_repeated_words():
    for text in ("a b c a b c", "a a a a", "a b c d", "x y", "a b c d a b c e f d a b"):
        ids = {}
        x = np.array([ids.setdefault(w, len(ids)) for w in text.split()])
        w = text.split()
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        want = len({i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)})
        assert quality.repeated_words(x, len(ids)) == want
        assert quality.repeated_words(x, 1 << 20) == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h2>Head&nbsp;line &amp; more</h2><p>First <b>bold
 text</b> here.<p>Second &lt;para&gt;.</p><div class="ad">Buy now</div><ul><li>item one</li><li>item two</li></ul><form><input><label>Mail</label></form></article>
<section id="comments"><p>I like it a lot, really a lot of words in a comment here</p></section><aside>Related</aside><footer>(c)</footer></body></html>"""

ARTICLE = "Head line & more\nFirst bold text here.\nSecond <para>.\nitem one\nitem two"


def test_html():
    weights = html_region.Weights.learn([PAGE])
    want = ARTICLE
    assert html_region.main_text(PAGE, weights) == want
    assert html_region.main_text(PAGE.replace("article", "div"), weights) == want  # no mark: by the weights alone
    assert html_region.main_text(PAGE[: PAGE.index("Second") + 9], weights).endswith("First bold text here.\nSecond &l")
    for empty in (None, "", "<html></html>", "<", "<p", "&amp;"):
        html_region.main_text(empty, weights)


def test_html_region_is_the_best():
    """The scan against all contiguous regions; ties go to the first and shortest."""
    rng = np.random.default_rng(9)
    for n in [*range(8), *[30] * 200]:
        score = [float(x) for x in rng.integers(-4, 5, n)]
        sums = {(a, b): sum(score[a:b]) for a in range(n) for b in range(a + 1, n + 1)}
        a, b = html_region.best_region(score)
        assert sum(score[a:b]) == max([0.0, *sums.values()])
        if (a, b) != (0, 0):
            assert b == min(y for (_, y), v in sums.items() if v == sums[a, b])
    assert html_region.best_region([1.0, -1.0, 1.0]) == (0, 1) and html_region.best_region([-1.0, 0.0]) == (0, 0)


def test_html_weights_decide():
    """Unlisted parts go because labelled pages show them outside; other weights, other text."""
    page = '<body><div class="zzmenu"><p>one two three</p></div><article><p>A first text.</p></article><div class="zzmenu"><p>four five</p></div><article><p>The second text.</p></article></body>'
    bare = page.replace("article", "section").replace("A first text.", "A first text of some length, " * 3 + "that goes on.").replace("The second text.", "The second text, " * 5 + "and so on.")
    weights = html_region.Weights.learn([page] * 30)
    assert weights.element["zzmenu"] < html_region.OUTSIDE and "<p>" not in {f for f, x in weights.element.items() if x < 0}
    assert html_region.main_text(page, weights) == "A first text.\nThe second text."  # all articles of a page
    assert html_region.main_text(bare, weights) == "A first text of some length, " * 3 + "that goes on.\n" + "The second text, " * 5 + "and so on."
    assert "four five" in html_region.main_text(bare, html_region.Weights())
    turned = html_region.Weights.learn([page.replace("article", "x").replace('div class="zzmenu"', "article").replace("</div>", "</article>")] * 30)
    assert html_region.main_text(page.replace("article", "x"), turned) != html_region.main_text(page.replace("article", "x"), weights)
    # a prior is outweighed by labelled pages
    said = '<body><nav>menu</nav><article><div class="widget"><p>' + "word " * 90 + "</p></div></article></body>"
    assert html_region.main_text(said, html_region.Weights.learn([])) == "" and "word" in html_region.main_text(said, html_region.Weights(element={**html_region.Weights.learn([]).element, "widget": 1.0}))


def test_html_parts():
    weights = html_region.Weights.learn([PAGE])
    text = lambda x: html_region.main_text(f"<body><article>{x}</article></body>", weights)
    assert text('<div class="article-header"><h1>Title here</h1></div><p>Body text.</p>') == "Title here\nBody text."
    assert text('<p>Body text.</p><article class="comment"><p>I disagree</p></article><p class="byline">By me<p>More.') == "Body text.\nMore."
    assert text('<p>Read <a href="#">the link</a> now.</p><div class="post-navigation"><a href="#">next one</a></div>') == "Read the link now."
    long = " ".join(f"w{i}" for i in range(20000))
    assert text(f"<p>{long}</p>") == long


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x"), (3, "v", "<p>a" * 500, "x")], "page_id long, url string, html string, text string")
    rows = html_region.extract_main_text(df, html_region.learn_weights(df)).collect()
    assert sorted((r["page_id"], r["n_chars"], len(r["text"])) for r in rows) == [(1, len(ARTICLE), len(ARTICLE)), (2, 0, 0), (2, 0, 0), (3, 999, 999)]
    empty = df.limit(0)
    assert html_region.extract_main_text(empty, html_region.learn_weights(empty)).count() == 0


def brute_overlaps(texts, items):
    out = {}
    for d, t in texts.items():
        w, hits = words(t), {}
        for i, x in items.items():
            v = words(x)
            for shift in range(-len(v), len(w)):
                same = [q for q in range(len(v)) if 0 <= q + shift < len(w) and w[q + shift] == v[q]]
                ok = any(same[k + 9] - same[k] < 12 for k in range(len(same) - 9)) if len(v) >= 12 else len(v) > 0 and len(same) == len(v)
                if ok:
                    hits[i] = max(hits.get(i, 0), len(same))
        out[d] = hits
    return out


def test_decontamination(spark):
    rng = np.random.default_rng(3)
    vocab = [f"v{i}" for i in range(50)]
    items = {i: " ".join(rng.choice(vocab, n)) for i, n in enumerate((12, 15, 30, 5, 1, 40))} | {6: "", 7: None}
    texts = {}
    for d in range(40):
        w = list(rng.choice(vocab, 60))
        if d % 2:
            v = items[int(rng.integers(0, 6))].split()
            for _ in range(d % 5):
                v[int(rng.integers(0, len(v)))] = "changed"
            at = int(rng.integers(0, 50))
            w[at:at] = v[: max(1, len(v) - d % 3)]
        texts[d] = " ".join(w)
    texts |= {100: None, 101: "", 102: texts[1], 103: items[2].upper()}
    bench = spark.createDataFrame(list(items.items()) + [(0, items[0])], "item_id long, text string")
    docs = spark.createDataFrame([(d, t, "k") for d, t in texts.items()], "doc_id long, text string, key string")
    rows = decontam.contamination(docs, bench).collect()
    want = brute_overlaps(texts, items)
    assert {r["doc_id"]: (r["item_ids"], r["n_matched"], r["contaminated"]) for r in rows} == {d: (",".join(map(str, sorted(h))), max(h.values(), default=0), bool(h)) for d, h in want.items()}
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(docs.limit(0), bench).count() == 0


def test_masks_miss_no_overlap():
    for gone in itertools.combinations(range(decontam.WINDOW), 2):
        assert any(not {o + x for x in m} & set(gone) for m in decontam.MASKS for o in range(decontam.WINDOW - m[-1]))


def brute_lines(texts):
    """id -> text without recurring lines, from the rule's definition in plain Python."""
    need = lambda n: 2 if n >= 50 else 3 if n >= 8 else 20
    found = {}  # (text, pos) -> masked tokens
    for t in {t for t in texts.values() if t is not None}:
        for i, line in enumerate(t.split("\n")):
            tokens = tuple("<*>" if any(c in "0123456789" for c in w) else w for w in line.replace("\x0b", " ").replace("\f", " ").replace("\r", " ").replace("\t", " ").split(" ") if w)
            if tokens:
                found[t, i] = tokens
    holders, words = collections.defaultdict(set), collections.Counter()
    for (t, _), x in found.items():
        holders[x].add(t)
    for x, ts in holders.items():
        words.update({(len(x), x[:3], p, w): len(ts) for p, w in enumerate(x) if w != "<*>"})
    template = {}
    for x in holders:
        least = math.ceil(len(x) * 0.8 - 1e-9)
        constant = sorted((-words[len(x), x[:3], p, w], p, w) for p, w in enumerate(x) if w != "<*>" and words[len(x), x[:3], p, w] >= need(len(x)))
        if len(constant) >= least:
            template[x] = (len(x), x[:3], tuple(sorted(c[1:] for c in constant[:least])))
    md5 = lambda t: hashlib.md5(t.encode()).digest()
    having = collections.defaultdict(set)
    for (t, _), x in found.items():
        if x in template:
            having[template[x]].add(t)
    gone = collections.defaultdict(set)
    for (t, i), x in sorted(found.items()):
        ts = having.get(template.get(x), ())
        if len(ts) >= need(len(x)) and (t != min(ts, key=md5) or any(found.get((t, j)) == x for j in range(i))):
            gone[t].add(i)
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[t]) for d, t in texts.items()}


def test_line_templates(documents, texts):
    out = templates.drop_recurring_lines(documents)
    assert out.columns == [*documents.columns, "n_lines", "n_dropped"]
    rows = {r["doc_id"]: r for r in out.collect()}
    want = brute_lines(texts)
    assert {d: r["text"] for d, r in rows.items()} == want
    assert sum("licence number" in rows[i]["text"] for i in range(80, 84)) == 1 and all(rows[i]["text"].startswith("Start") for i in range(80, 84))
    for d, t in texts.items():
        assert (rows[d]["n_dropped"] > 0) == (want[d] != t)
    assert rows[70]["n_lines"] == 0 and rows[71]["n_lines"] == 1


def lines_frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def letters(rng, n):
    """A line of n words without digits that no other line has."""
    return " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(n))


def test_line_templates_clean_lines_stay(spark):
    """Rows of numbers, and lines of a large leaf that share each word but no template."""
    rng = np.random.default_rng(6)
    rows = [" ".join(str(x) for x in rng.integers(0, 10**6, 9)) for _ in range(12)]
    # each word at its position in many lines, but no eight of ten positions alike in three
    crowd = ["one two three " + " ".join("abcde"[int(k)] * 3 for k in rng.integers(0, 5, 7)) for _ in range(60)]
    form = [f"Filed under the usual terms by {letters(rng, 1)} of our house" for _ in range(4)]
    texts = [f"{rows[i % 12]}\n{crowd[i]}\n{form[i] if i < 4 else ''}\n{letters(rng, 60)}" for i in range(60)]
    found = sorted(templates.drop_recurring_lines(lines_frame(spark, texts)).collect(), key=lambda r: r["doc_id"])
    assert sum(form[i] in found[i]["text"] for i in range(4)) == 1  # a template stays in one text
    for i, r in enumerate(found):
        alike = sum(sum(a == b for a, b in zip(crowd[i].split(), x.split(), strict=True)) >= 8 for x in crowd)
        assert rows[i % 12] in r["text"] and (alike >= 3 or crowd[i] in r["text"])
        assert r["n_dropped"] <= 2


def test_line_templates_mostly_shared(spark):
    """Whatever part of a text recurs, one text keeps each passage and each footer, once."""
    rng = np.random.default_rng(5)
    shared, footer = [letters(rng, 42) for _ in range(2)], letters(rng, 10)
    own = [letters(rng, 8) for _ in range(4)]
    texts = [f"{shared[0]}\n{own[0]}", f"{shared[0]}\n{own[1]}", f"{shared[0]}\n{shared[1]}\n{own[2]}", f"{shared[1]}\n{own[3]}", f"{shared[1]}\n{footer}\n{footer}", f"{footer}\n{letters(rng, 60)}", f"{footer}\n{letters(rng, 70)}"]
    out = {r["doc_id"]: r for r in templates.drop_recurring_lines(lines_frame(spark, texts)).collect()}
    kept = collections.Counter(x for r in out.values() for x in r["text"].split("\n"))
    assert [kept[x] for x in (*shared, footer)] == [1, 1, 1] and all(kept[x] == 1 for x in own)
    assert sum(r["n_dropped"] for r in out.values()) == 2 + 2 + 3
    assert {d: r["text"] for d, r in out.items()} == brute_lines(dict(enumerate(texts)))


def test_line_templates_short_lines(spark):
    """One or two words recur by chance: in 20 texts they are a template, in 19 they aren't."""
    rng = np.random.default_rng(8)
    texts = [f"{letters(rng, 60)}\nLes.\n{'And so' if i < 19 else 'x 1'}\n12 34" for i in range(25)]
    out = {r["doc_id"]: r["text"] for r in templates.drop_recurring_lines(lines_frame(spark, texts)).collect()}
    assert sum("Les." in t for t in out.values()) == 1 and sum("And so" in t for t in out.values()) == 19 and all("12 34" in t for t in out.values())
    assert out == brute_lines(dict(enumerate(texts)))


def test_line_templates_passages_of_two(spark):
    """A line of 50 words stays in one of two texts, one of 49 in both; copies of a text are one text."""
    rng = np.random.default_rng(7)
    passage, shorter, single = (letters(rng, n) for n in (50, 49, 60))
    texts = [f"{letters(rng, 80)}\n{passage}\n{shorter}" for _ in range(2)] + [f"{letters(rng, 80)}\n{single}"] * 3
    out = [r["text"] for r in templates.drop_recurring_lines(lines_frame(spark, texts)).collect()]
    assert sum(passage in t for t in out) == 1 and sum(shorter in t for t in out) == 2 and sum(single in t for t in out) == 3


def test_line_templates_broadcast_nothing(documents, monkeypatch):
    """Every table of the operator grows with the corpus: none goes through the driver."""
    plans, save = {}, Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or save(self, df, name))
    plans["result"] = templates.drop_recurring_lines(documents)._jdf.queryExecution().executedPlan().toString()
    assert len(plans) > 9 and not [name for name, plan in plans.items() if "Broadcast" in plan]


def test_line_templates_mask_once(documents):
    """No filter works out the masked line for itself."""
    lines = templates._lines(documents, "text")
    plan = lines._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert any("regexp_replace" in x for x in plan) and not any("Filter" in x and "regexp_replace" in x for x in plan)
    assert lines.where("n < 1").count() == 0


def test_line_templates_empty(documents):
    assert templates.drop_recurring_lines(documents.limit(0)).count() == 0


def test_url_rules(spark):
    urls = ["http://a.net/x", "https://WWW.Example.net/en/1?q", "http://example.net/english", "http://example.com/de/", "http://x.example.org/fr/a#b", "http://notexample.com/de/", "nourl", None, "", "http://net", "http://a.net/x"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame([("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "block"), ("net/", "block")], url_rules.RULE_SCHEMA)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, rules).collect()}
    assert got == {
        0: ("a.net", "/x", "net/", "block"), 1: ("www.example.net", "/en/1", "example.net/en/", "allow"), 2: ("example.net", "/english", "net/", "block"), 3: ("example.com", "/de/", "example.com/de/", "block"),
        4: ("x.example.org", "/fr/a", "org/fr/", "allow"), 5: ("notexample.com", "/de/", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
        9: ("net", "", None, "allow"), 10: ("a.net", "/x", "net/", "block"),
    }
    assert url_rules.judge_urls(pages, rules.limit(0)).where("verdict <> 'allow'").count() == 0


def test_language_model_counts(documents, texts):
    rows = {r["doc_id"]: r for r in lbl.score_texts(documents, crc_mod("doc_id", 5) != 1).collect()}
    tokens = {d: [*words(t), None] for d, t in texts.items()}
    c = collections.Counter(x for d, w in tokens.items() if zlib.crc32(str(d).encode()) % 5 != 1 for x in w)
    n, v = sum(c.values()), len(c)
    for d, w in tokens.items():
        assert rows[d]["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert (rows[d]["n_tokens"], rows[d]["n_known"], rows[d]["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)


def test_language_model_tokens(monkeypatch):
    """Tokens of batches that are slices of others, as plain code finds them; a word that
    repeats in a batch is hashed once."""
    hashed, digest = [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda x: hashed.append(x) or digest(x))
    lbl._hashed(pa.array(["one two one", "Two  three"] * 50))
    assert sorted(hashed) == [b"one", b"three", b"two"]
    monkeypatch.undo()
    odd = [None, "", " \t\n ", "A\x1cB c\x85d E\u2003x\u3000", "\x0bÄÖ İI\x0c\r ZZ\x00z  y\x1f w", "one two one", "\ufeffa", "x" * 9000 + " " + "y " * 5000, "\ud7ff\U0010ffff K"]
    plenty = [f"A{i} b\nc " * (i % 5) for i in range(1500)] + odd
    for kind in (pa.string(), pa.large_string()):
        for a, n in ((0, 500), (500, 500), (1000, 509), (1503, 4), (7, 0)):
            h, suffix, place, start, size = lbl._hashed(pa.array(plenty, kind).slice(a, n))
            assert len(size) == n and len(place) == size.sum()
            for text, at, m in zip(plenty[a : a + n], start, size, strict=True):
                assert h[place[at : at + m]].tolist() == [*(xxhash.xxh3_64_intdigest(x) for x in words(text)), int(lbl.END)]
                assert suffix[place[at : at + m]].tolist() == [*(zlib.crc32(x[-2:]) % lbl.SUFFIX for x in words(text)), -1]


def test_language_model_step_is_the_gradient():
    """A step over one batch, repeated classes and noise included, against plain sums in double
    precision."""
    rng = np.random.default_rng(2)
    classes, n = 40, lbl.BATCH
    i, j, w = rng.integers(0, classes + 1, n), rng.integers(0, classes + 1, n), rng.integers(0, 7, n)
    unigram = np.bincount(w, minlength=classes).astype(float)
    model = lbl.LogBilinear.start(unigram)
    r, (first, second), q, b = model.r.copy(), [x.copy() for x in model.mix], model.q.copy(), model.b.copy()
    adam = lbl.Adam(model)
    model.learn(adam, i, j, w, unigram, np.random.default_rng(9), 0.0, 1.0)
    same = np.random.default_rng(9)
    same.permutation(n)
    share = (unigram + 0.5) / (unigram + 0.5).sum()
    noise = np.minimum(np.searchsorted(np.cumsum(share), same.random(lbl.NOISE)), classes - 1)
    grads = [np.zeros_like(x) for x in (r, first, second, q, b)]
    for x, y, z in zip(i, j, w, strict=True):
        hidden = r[x] @ first + r[y] @ second
        g_hidden = np.zeros(lbl.DIM)
        for k, wanted in [(z, 1), *((k, 0) for k in noise)]:
            s = hidden @ q[k] + b[k] - np.log(share[k]) - np.log(lbl.NOISE)
            g = (1 / (1 + np.exp(-s)) - wanted) / n
            grads[3][k] += g * hidden
            grads[4][k] += g
            g_hidden += g * q[k]
        grads[0][x] += first @ g_hidden
        grads[0][y] += second @ g_hidden
        grads[1] += np.outer(r[x], g_hidden)
        grads[2] += np.outer(r[y], g_hidden)
    assert model.r.dtype == np.float32 and adam.t == 1
    flat = np.concatenate([g.ravel() for g in grads])
    assert np.allclose(adam.mean, flat, rtol=1e-3, atol=1e-7) and np.abs(flat).max() > 1e-3
    moved = adam.x - np.concatenate([x.ravel() for x in (r, first, second, q, b)])
    clear = np.abs(flat) > 1e-6  # the first step of each parameter is the rate, against its gradient
    assert np.allclose(moved[clear], -lbl.RATE * np.sign(flat[clear]), rtol=1e-2)


def test_language_model_is_normalised():
    rng = np.random.default_rng(1)
    side = lbl.CLASSES + 1
    cells = np.unique(rng.integers(0, side * side * lbl.CLASSES, 500))
    model = lbl.LogBilinear.fit(cells, rng.integers(1, 9, len(cells)), steps=30)
    p = 10.0 ** model.log10_probabilities().astype(float)
    assert np.allclose(p.sum(axis=2), 1, atol=1e-4)


def test_language_model_learns_from_every_token(documents, spark):
    """The draws, and the classes, grow with the training tokens."""
    assert lbl.own_words(0) == 95 and lbl.own_words(8 << 20) == 223 < lbl.own_words(5 * 10**9)
    rows = [(i, " ".join(f"w{(7 * i + k * k) % 50}" for k in range(4000))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    scratch = Scratch(spark, "test")
    head = lbl.head_of(scratch.save(lbl.token_counts(docs, "text"), "counts"))
    coded = scratch.save(lbl.encoded(docs, head, F.lit(True), "doc_id", "text"), "rows")
    model, drawn = lbl.trained(coded, head)
    assert drawn == head.n == 500 * 4001 and len(model.q) == head.classes > lbl.CLASSES
    i, j, w = lbl.sequences([r["classes"] for r in coded.limit(20).collect()], head.classes)
    p = model.log10_probabilities()[i, j, w]
    unigram = np.log10(lbl.unigrams(head)[w] / head.n)
    assert p.mean() > unigram.mean()
    z = model.log_normalisers()[i, j]
    s = ((model.r[i] @ model.mix[0] + model.r[j] @ model.mix[1]) * model.q[w]).sum(axis=1) + model.b[w]
    assert np.allclose((s - z) / np.log(10), p, atol=1e-3)


def test_toxicity_learns():
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(400):
        w = list(rng.choice(vocab, int(rng.integers(5, 60))))
        if i % 4 == 0:
            w[int(rng.integers(0, len(w)))] = rng.choice(["nasty", "awful!", "Vile"])
        texts.append(" ".join(w))
        labels.append(float(i % 4 == 0))
    ids, y = [textcnn.word_ids(t) for t in texts], np.array(labels)
    model = textcnn.TextCNN.fit(ids[:300], y[:300], 0.0)
    assert ((model.logits(ids[300:]) > 0) == (y[300:] == 1)).mean() > 0.95
    each = np.array([np.maximum(model._pooled(i)[0], 0) @ model.out + model.out_bias for i in ids[:50]])
    assert np.allclose(each, model.logits(ids[:50]), atol=1e-4)


def test_toxicity_edges(spark, documents, texts):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    out = textcnn.score_toxicity(documents, textcnn.fit_toxicity(documents, labels, F.col("doc_id") > 5)).collect()
    assert len(out) == len(texts) and all(0 <= r["score"] <= 1 for r in out)
    none = textcnn.fit_toxicity(documents, labels.limit(0), F.lit(True))
    assert {round(r["score"], 6) for r in textcnn.score_toxicity(documents, none).collect()} == {0.5}


def test_toxicity_wordless_labels(spark):
    """Null, empty and wordless texts among the labelled rows are trained on as empty."""
    texts = [None, "", "!!", "  "] + ["bad words here"] * 30 + ["nice calm words"] * 30
    docs = spark.createDataFrame([(i, t, None if i % 5 else "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(t is not None and "bad" in t)) for i, t in enumerate(texts)], "doc_id long, toxic int")
    fitted = textcnn.fit_toxicity(docs, labels, F.lit(True))
    scores = {r["doc_id"]: r["score"] for r in textcnn.score_toxicity(docs, fitted).collect()}
    assert len({scores[i] for i in range(4)}) == 1 and scores[0] < scores[4] and scores[40] < scores[4]
    empty = textcnn.fit_toxicity(docs.limit(0), labels.limit(0), F.lit(True))
    assert textcnn.score_toxicity(docs.limit(0), empty).count() == 0


def test_context_trees_code_lengths():
    """Against a direct walk down the contexts of each byte."""
    samples = {"a": ["abracadabra", "banana band"], "b": ["xylophone", "banal xenon"]}
    trees = ppm.ContextTrees.fit(samples)

    def direct(text, lang):
        counts = collections.defaultdict(collections.Counter)
        for t in samples[lang]:
            s = ppm._bytes(t)
            for i in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    counts[s[i - k : i]][s[i]] += 1
        s, bits = ppm._bytes(text), 0.0
        for i in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER, -1, -1):
                c = counts.get(s[i - k : i])
                if c is None:
                    continue
                n, d = sum(c.values()), len(c)
                if s[i] in c:
                    bits -= math.log2(c[s[i]] / (n + d))
                    break
                bits -= math.log2(d / (n + d))
            else:
                bits += 8
        return bits

    tests = ["banana", "xenophobe", "", "zzz", "Abra É", "b" * 300]
    got = trees.bits(tests)
    for i, t in enumerate(tests):
        for j, lang in enumerate(trees.langs):
            assert got[i, j] == pytest.approx(direct(t, lang), rel=1e-4, abs=1e-4)


def test_language_id(documents, texts):
    trees = ppm.fit_trees(documents, crc_mod("doc_id", 4) != 2, "doc_id", "text", "lang")
    rows = {r["doc_id"]: r for r in ppm.predict_language(documents, trees).collect()}
    langs = {r["doc_id"]: r["lang"] for r in documents.collect()}
    held = [d for d in range(60) if zlib.crc32(str(d).encode()) % 4 == 2]
    assert held and all(rows[d]["lang_pred"] == langs[d] for d in held)
    for d in (70, 71, 72, 76):
        assert rows[d]["lang_pred"] == "und" and rows[d]["score"] == 0
    assert len(rows) == len(texts)
    kept = ppm.accepted(documents, trees)
    assert kept.columns == documents.columns and {70, 71, 72, 76} & {r["doc_id"] for r in kept.select("doc_id").collect()} == set()


@pytest.fixture(scope="module")
def vocab():
    return sampled_pieces.load_vocabulary(None, "/opt/tokenizers/piece_bpe_32k.model")


def all_paths(vocab, text):
    index = {vocab.pieces[i]: i for i in np.flatnonzero(vocab.usable)}

    def walk(s):
        if not s:
            yield (), 0.0
        for n in range(1, min(len(s), 16) + 1):
            if s[:n] in index:
                for rest, w in walk(s[n:]):
                    yield (index[s[:n]], *rest), vocab.weights[index[s[:n]]] + w

    paths = dict(walk(sampled_pieces.SPACE + text.replace(" ", sampled_pieces.SPACE)))
    z = np.logaddexp.reduce(list(paths.values()))
    return {k: math.exp(w - z) for k, w in paths.items()}


def test_samples_follow_the_distribution(vocab):
    lattices, n = sampled_pieces.Lattices(vocab), 6000
    p = all_paths(vocab, "the test")
    out = sampled_pieces.encode_batch(lattices, ["the test"] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919), 3)
    first = collections.Counter(tuple(s[0]["ids"].tolist()) for s in out)
    assert max(abs(first[k] / n - q) for k, q in p.items()) < 0.025
    pairs = collections.Counter(tuple(tuple(x["ids"].tolist()) for x in s[:2]) for s in out)
    for (a, b), k in pairs.most_common(5):  # without replacement
        assert k / n == pytest.approx(p[a] * p[b] / (1 - p[a]), abs=0.03)
    for s in out[:300]:
        assert len({tuple(x["ids"].tolist()) for x in s}) == 3
        assert [x["score"] for x in s] == sorted((x["score"] for x in s), reverse=True)
        for x in s:
            assert x["log_prob"] == pytest.approx(math.log(p[tuple(x["ids"].tolist())]), abs=1e-3)
    # inclusion probabilities weigh samples to an unbiased estimate
    want = sum(q * len(k) for k, q in p.items())
    got = np.mean([sum(math.exp(x["log_prob"]) / x["inclusion"] * len(x["ids"]) for x in s) for s in out])
    assert got == pytest.approx(want, rel=0.05)


def test_round_trip(vocab):
    lattices = sampled_pieces.Lattices(vocab)
    texts = ["", " ", "a", "\n\n", "▁x ▁", "日本 語 😀 x\x00y", "  two  spaces \n end ", "\ttab\r\n", "é" * 50, "word " * 400, None]
    for t, s in zip(texts, sampled_pieces.encode_batch(lattices, texts, np.arange(len(texts), dtype=np.uint64), 4), strict=True):
        assert (s is None) == (t is None)
        for x in s or []:
            assert sampled_pieces.decode(vocab, x["ids"]) == t


def test_encode_rows(documents, texts, vocab):
    one = sampled_pieces.encode_documents(documents, vocab).orderBy("doc_id").collect()
    two = sampled_pieces.encode_documents(documents.repartition(1), vocab).orderBy("doc_id").collect()
    assert one == two and len(one) == len(texts) and all(r["round_trip"] for r in one)
    assert one[70]["samples"] is None or texts[one[70]["doc_id"]] is not None
