import hashlib
import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.llm import chat, decontamination, exact, html_extract, langid, packing, secrets, toxicity
from tests.llm.labelled_pages import HELD_OUT, PAGES


def test_exact(spark, odd, none):
    rows = exact.exact_duplicates(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 12 and exact.exact_duplicates(none).count() == 0
    assert (by[5].keep_id, by[5].kept, by[6].kept, by[5].group_size) == (6, False, True, 2)
    assert by[1].keep_id == 2 and by[1].text_sha256 == hashlib.sha256(b"").hexdigest()


def test_index_keeps_earlier_rows(spark):
    index = exact.DigestIndex(spark, buckets=2)
    table = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    exact.exact_duplicates(table((1, "a"), (2, "a")), index)
    got = {r.doc_id: r for r in exact.exact_duplicates(table((9, "a"), (8, "b")), index).collect()}
    assert (got[9].keep_id, got[9].kept, got[8].kept, index.rows().count()) == (2, False, True, 2)


def test_toxicity_folds_and_excuses():
    clean = [f"the garden number {k} has flowers and w{k} trees" for k in range(200)] + [f"the clown fish {k} swims near w{k}" for k in range(20)]
    bad = [f"you {word} of w{k} go away now" for k, word in enumerate(["idiot", "clown", "scum"] * 40)]
    model = toxicity.fit(clean + bad, [0] * len(clean) + [1] * len(bad))
    automaton = model.automaton()

    def weight(t):
        return toxicity.weigh(automaton, toxicity.fold(t))

    assert weight("such an 1d10t") > 0 and weight("such an іdіоt!") > 0 and weight("id​iot") > 0  # digits, Cyrillic, zero width
    assert weight("an ïdíót") > 0 and weight("\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d") > 0 and weight("ｉｄｉｏｔ") > 0  # accents, mathematical and full-width letters
    assert weight("a clown fish") == 0 < weight("you clown")
    assert weight("a quiet garden") == 0
    assert toxicity.fit([], []).lexicon == {}


def test_toxicity_held_out_and_odd_rows(spark, odd, none):
    docs = spark.createDataFrame([(k, ("you idiot %d go" if k % 5 == 0 else "a calm garden %d here") % k) for k in range(600)], "doc_id long, text string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0).alias("toxic"))
    model = toxicity.learn(docs, labels)
    out = toxicity.toxicity(docs, model).where("held_out")
    assert out.where((F.col("predicted") == 1) != (F.col("doc_id") % 5 == 0)).count() == 0 < out.count()
    rows = toxicity.toxicity(odd, model)
    assert rows.count() == 12 and rows.columns == ["doc_id", "held_out", "score", "predicted"] and toxicity.toxicity(none, model).count() == 0
    assert {r.doc_id: r.held_out for r in rows.collect() if r.doc_id}[4] == (zlib.crc32(b"4") % 3 == 1)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav></header><div class="cookie-notice">We use cookies. Accept them all now.</div>
<main><article><h1>The &amp; title</h1><p><b>First   paragraph, with
text.<br><p>Second one &mdash; longer, with <a href=x>a link</a> inside it.<form><input><button>Send</button></form>
<ul><li>An item<li>Another</ul><div class="ad">Buy this fine thing today.</div><blockquote>Quoted words.</blockquote></article>
<section id="comments"><p>Nice post, thank you for writing all of this, it was really useful.</p></section></main>
<aside class="sidebar"><p>Related stories of the day, all of them.</p></aside><footer>&copy; Somebody</footer></body></html>"""


def test_main_text():
    want = "The & title\nFirst paragraph, with text.\nSecond one — longer, with a link inside it.\nAn item\nAnother\nQuoted words."
    assert html_extract.main_text(PAGE) == want
    assert html_extract.main_text("<p>Just a paragraph of plain text, without any structure.") == "Just a paragraph of plain text, without any structure."
    for broken in ("<", "<<<>>", "<p", "</div></div>", "<!--", "<script>", "&#xZZ; &bogus; <b>", "<a b='c>"):
        html_extract.main_text(broken)


def test_minimum_cut_equals_all_labellings():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randint(1, 7)
        ends = [(rng.random() * 3, rng.random() * 3) for _ in range(n)]
        edges = [(a, b, rng.random()) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(labels):
            return sum(c[0] if not x else c[1] for x, c in zip(labels, ends)) + sum(c for a, b, c in edges if labels[a] != labels[b])

        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(html_extract.min_cut(ends, edges)) == pytest.approx(best)


def judged(pages, smooth):
    """Lines missed, and lines that don't belong."""
    missed = extra = 0
    for page, want in pages:
        got = html_extract.main_text(page, smooth=smooth).split("\n")
        missed += sum(not any(g.startswith(w) for g in got) for w in want)
        extra += sum(bool(g) and not any(g.startswith(w) for w in want) for g in got)
    return missed, extra


def test_the_cut_decides():
    """Lines that are too short to be told by themselves go with their neighbours."""
    assert judged(PAGES, True) == (0, 0) and judged(PAGES, False)[0] >= 5
    with_cut, without = judged(HELD_OUT, True), judged(HELD_OUT, False)
    assert sum(with_cut) < sum(without) and sum(with_cut) <= 1


def test_weights_are_fitted_to_labelled_blocks(spark):
    rng = random.Random(2)
    some = lambda n: " ".join(rng.choice(("lake", "stone", "river", "above", "light")) for _ in range(n))
    page = lambda k: f"<nav><a href=a>{some(2)}</a></nav><footer>{some(9)}</footer><main>" + "".join(f"<p>{some(30)}.</p>" for _ in range(k % 4 + 1)) + "</main>"
    pages = spark.createDataFrame([(page(k),) for k in range(60)] + [(None,)], "html string")
    weights = html_extract.learn(pages)
    assert weights == html_extract.learn(pages) != html_extract.DEFAULT and weights[1] > 0 > weights[2]
    assert html_extract.learn(pages.limit(0)) == html_extract.DEFAULT


def test_inline_parts_that_markup_sets_apart_go():
    page = "<article><p>One long line of the article, <span class='ad'>Buy our pills now</span> which goes on <button>Subscribe</button>to its end.</p><p>Two <math>x = 1</math> and more.</p></article>"
    assert html_extract.main_text(page) == "One long line of the article, which goes on to its end.\nTwo x = 1 and more."
    for open_tag in ("<select>", "<svg>", "<noscript>"):  # never closed
        assert "goes on" in html_extract.main_text(f"<article><p>Before.</p>{open_tag}<p>The article goes on behind it.</p></article>")


@pytest.mark.parametrize("page", ["<a b " * 40_000, "<a \"'>" * 30_000, "<div>x" * 30_000, "<i>" * 1000 + "<p>a" * 30_000, "<div>" * 20_000 + "</b>" * 20_000, "<svg>a" * 30_000, "<p>" + "<span class=ad>x</span>y" * 8000])
def test_hostile_pages_take_linear_time(page):
    start = time.perf_counter()
    html_extract.main_text(page)
    assert time.perf_counter() - start < 10


def test_pages(spark):
    rows = [(1, "u", PAGE, 1), (2, None, None, 1), (None, "u", "", 1), (3, "u", "<p>word " * 50_000, 1), (1, "u", PAGE, 1)]
    schema = "page_id long, url string, html string, text long"
    got = html_extract.extract(spark.createDataFrame(rows, schema)).collect()
    assert [r.n_chars for r in got if r.page_id == 1] == [len(html_extract.main_text(PAGE))] * 2
    assert {r.text for r in got if r.page_id not in (1, 3)} == {""}
    assert html_extract.extract(spark.createDataFrame([], schema)).collect() == []


def test_language(spark, odd, none):
    rng = random.Random(1)
    words = {"aa": ["kato", "kalu", "mikata", "tokalu"], "bb": ["schreb", "ungisch", "breschung", "streb"]}
    rows = [(k, lang, " ".join(rng.choice(words[lang]) + rng.choice(["", "n", "s"]) for _ in range(30))) for k in range(300) for lang in [rng.choice(["aa", "bb"])]]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    field = langid.learn(docs)
    got = langid.identify(docs, field).join(docs, "doc_id")
    assert got.where("held_out and lang <> lang_pred").count() == 0 < got.where("held_out").count()
    labelled = langid.Labeller(field).words("kato tokalu mikata schreb ungisch breschung streb")
    assert [lang for _, lang, _ in labelled] == ["aa"] * 3 + ["bb"] * 4
    out = {r.doc_id: r for r in langid.identify(odd, field).collect()}
    assert out[1].lang_pred == out[2].lang_pred == "und" and langid.identify(none, field).count() == 0


def test_forward_backward_equals_enumeration():
    import itertools

    import numpy as np

    rng = np.random.Generator(np.random.PCG64(0))
    scores, moves = rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
    total, want = 0.0, np.zeros((5, 2))
    for path in itertools.product(range(2), repeat=5):
        weight = np.exp(sum(scores[k, y] for k, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])) + np.log(np.exp(moves[:, path[0]]).sum()))
        total += weight
        for k, y in enumerate(path):
            want[k, y] += weight
    assert np.allclose(langid.marginals(scores, np.array([5]), moves), want / total)
    many = rng.normal(size=(200, 2))
    whole = langid.marginals(many, np.array([150, 50]), moves)
    langid.SEGMENT, before = 7, langid.SEGMENT
    try:
        assert np.allclose(whole, langid.marginals(many, np.array([150, 50]), moves))
    finally:
        langid.SEGMENT = before


def test_expected_moves_equal_all_labellings():
    """The gradient of the transitions, against every labelling of short texts."""
    rng = np.random.default_rng(5)
    for n, k in ((2, 2), (4, 3), (5, 2)):
        scores, moves = rng.normal(size=(n, k)), rng.normal(size=(k, k))
        want, total = np.zeros((k, k)), 0.0
        start = np.log(np.exp(moves).sum(axis=0))  # any label may stand in front of the first
        for labels in itertools.product(range(k), repeat=n):
            weight = np.exp(start[labels[0]] + sum(scores[t, y] for t, y in enumerate(labels)) + sum(moves[a, b] for a, b in zip(labels, labels[1:])))
            total += weight
            for a, b in zip(labels, labels[1:]):
                want[a, b] += weight
        messages, inside = np.zeros((n, k)), np.array([False] + [True] * (n - 1))
        p = langid.marginals(scores, np.array([n]), moves, messages)
        assert np.allclose(langid.expected_moves(p, messages, moves, inside), want / total)


def test_weighing_equals_plain_search():
    rng = random.Random(9)
    model = toxicity.Model({" ab": 1.0, " abc ": 2.0, "bb": 0.5, " ca": 3.0}, [" ca bb ", " abc a "])
    automaton = model.automaton()
    for _ in range(500):
        text = toxicity.fold("".join(rng.choice("abc ") for _ in range(rng.randint(0, 40))))
        spots = lambda p: [k for k in range(len(text)) if text.startswith(p, k)]
        free = [(k, k + len(p)) for p in model.excused for k in spots(p)]
        want = sum(w for p, w in model.lexicon.items() for k in spots(p) if not any(a <= k and k + len(p) <= b for a, b in free))
        assert toxicity.weigh(automaton, text) == pytest.approx(want)


def test_decontamination(spark, odd, none):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(rng.randint(15, 59)))) for k in range(30)] + [(90, None), (91, ""), (92, "two words")]
    clean = lambda n: [word() for _ in range(n)]
    rows, leaks = [], set()
    for k in range(120):
        own = clean(80)
        if k % 3 == 0:
            passage = items[k % 30][1].upper().split()
            for _ in range(len(passage) // 9):
                passage[rng.randrange(len(passage))] = word()  # substitutions
            if k % 2:
                del passage[len(passage) // 2]  # a word left out
            at = rng.randrange(80)
            own[at:at] = passage
            leaks.add(k)
        rows.append((k, ", ".join(own)))
    rows += [(500, " ".join(items[0][1].split()[:6] + clean(50))), (501, "has two words here")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id for r in decontamination.decontaminate(docs, bench).where("contaminated").collect()}
    assert got == leaks | {501}
    assert {r.doc_id for r in decontamination.without_leaks(docs, bench).collect()} == {i for i, _ in rows} - got
    assert decontamination.decontaminate(odd, bench).count() == 12 and decontamination.decontaminate(none, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_judges_rows_by_themselves(spark, monkeypatch):
    passage = lambda k: " ".join(f"w{k}x{i}" for i in range(20))
    bench = spark.createDataFrame([(k, passage(k)) for k in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(None, passage(3)), (7, passage(4) + " " + passage(11)), (7, "all is clean here, nothing to see")], "doc_id long, text string")
    whole = sorted(map(str, decontamination.decontaminate(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "CHUNK", 1)
    assert sorted(map(str, decontamination.decontaminate(docs, bench).collect())) == whole
    assert sum("contaminated=True" in r for r in whole) == 2
    assert [tuple(r) for r in decontamination.without_leaks(docs, bench).collect()] == [(7, "all is clean here, nothing to see")]


def naive_overlap(text, item):
    """Share of the item found in the text: every place and every diagonal tried, in plain Python."""
    split = lambda t: "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in t.lower()).split()
    words, own = split(text or ""), split(item or "")
    if not own:
        return 0.0
    if len(own) < 5:
        return float(any(words[p : p + len(own)] == own for p in range(len(words))))
    diagonals = {
        p - q
        for mask in decontamination.MASKS
        for p in range(len(words) - mask[-1])
        for q in range(len(own) - mask[-1])
        if all(words[p + m] == own[q + m] for m in mask)
    }
    held = []
    for d in sorted(diagonals):
        hits, kept = [q for q in range(len(own)) if 0 <= q + d < len(words) and words[q + d] == own[q]], set()
        while hits:
            score = best = 1
            end = 0
            for k in range(1, len(hits)):
                score += 1 - 2 * (hits[k] - hits[k - 1] - 1)
                if score < best - decontamination.DROP or score < 0:
                    break
                if score > best:
                    best, end = score, k
            if end + 1 >= decontamination.LEAST_SEGMENT:
                kept.update(hits[: end + 1])
            hits = hits[end + 1 :]
        if kept:
            held.append((d, kept))
    best = 0
    for d, _ in held:
        best = max(best, len(set().union(*(s for e, s in held if 0 <= e - d <= max(2, len(own) // 4)))))
    return best / len(own)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")  # noqa: E731 - few words, so that chance hits are many
    items = [(k, " ".join(word() for _ in range(rng.randint(3, 24)))) for k in range(25)] + [(25, "so so so so so so so so")]
    rows = []
    for k in range(60):
        own = [word() for _ in range(rng.randint(0, 120))]
        passage = items[k % 26][1].split()
        for _ in range(rng.randint(0, len(passage) // 3)):
            passage[rng.randrange(len(passage))] = word()
        own[len(own) // 2 : len(own) // 2] = passage
        rows.append((k, " ".join(own)))
    rows += [(60, "so " * 400), (61, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, text in rows:
        shares = {str(k): share for k, item in items if (share := naive_overlap(text, item)) >= decontamination.COVERAGE}
        want[i] = (",".join(sorted(shares)), max(shares.values(), default=0.0))
    assert {r.doc_id: (r["items"], r.best_overlap) for r in decontamination.decontaminate(docs, bench).collect()} == want


def test_long_repetitive_text_is_searched_in_linear_time():
    items = decontamination.Items([b"alpha beta gamma delta epsilon zeta " * 8])
    took = []
    for n in (2000, 8000):
        words = decontamination.tokens(b"alpha beta gamma delta epsilon zeta " * n)
        start = time.perf_counter()
        assert items.search(words) == [(0, 1.0)]
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] + 0.5


def test_secrets(spark, odd, none):
    import re

    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    hexes = lambda k: hashlib.sha256(str(k).encode()).hexdigest()
    texts = [f"x Password = '{hexes(k)[:18]}' y token:short secret=token=abcdefghijkl APIKEY: AKIA{hexes(k)[:16].upper()} z {hexes(k)[:16 + k % 9]}" for k in range(40)]
    for t in texts:
        want = [(m.start(), m.end(), "assign") for m in pattern.finditer(t) if len(m[2]) >= 12]
        want += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert [s[:3] for s in secrets.base_spans(t)] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    formats = secrets.learn(docs)
    assert set(formats.automata) == {"assign", "access", "hex"}
    new = "see AKIB" + hexes(99)[:16].upper() + " and someordinaryword2"
    assert [new[a:b] for a, b, _ in formats.added(new, secrets.base_spans(new))] == ["AKIB" + hexes(99)[:16].upper()]
    assert secrets.scan(odd, formats).count() == 12 and secrets.scan(none, formats).count() == 0
    long = f"secret: {'ab1' * 200_000} {'Zz9' * 100_000}"
    row = secrets.scan(spark.createDataFrame([(1, long)], "doc_id long, text string"), secrets.learn(docs.unionByName(spark.createDataFrame([(99, long)], docs.schema)))).first()
    assert (row.n_assign, row.n_hex, row.spans) == (1, 1, "assign:0:600008,hex:8:600008")


def planted(seed, labelled):
    """Documents with credentials of four formats, some assigned to a name and some bare, among look-alikes."""
    rng = random.Random(seed)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    mixed = digits + lower + lower.upper()
    makers = [
        lambda: "pay_live_" + some(mixed, 24),
        lambda: "ghz-" + some(mixed, 36),
        lambda: "-".join(some(digits + "ABCDEF", 6) for _ in range(4)),
        lambda: some(mixed, 20) + "." + some(mixed, rng.choice((6, 12))),
    ]
    rows, bare = [], {}
    for k in range(400):
        words = [some(lower, rng.randint(2, 12)) for _ in range(30)]
        words += [
            f"mail{k}.example.com", f"10.{k % 250}.17.{k % 99}", "2024-05-%02dT10:15:%02d" % (k % 28 + 1, k % 60), f"https://www.site{k}.org/a/b{k}/index.html",
            f"report_{k}_final.txt", "internationalisation", f"v{k}.12.3-beta.{k}", "co-operation-wise", "+49-30-123456%02d" % (k % 100), f"order/{k}/2024/{k % 7}",
        ]
        rng.shuffle(words)
        value = makers[k % 4]()
        words.insert(rng.randrange(30), f"token = {value}" if labelled else value)
        text = " ".join(words)
        if not labelled:
            bare[k] = text.index(value), text.index(value) + len(value)
        rows.append((k, text))
    return rows, bare


def test_secrets_of_learned_formats_are_found(spark):
    """Formats learned from assigned values find bare ones, which no base pattern finds, and nothing else."""
    train, _ = planted(1, True)
    test, bare = planted(2, False)
    formats = secrets.learn(spark.createDataFrame(train, "doc_id long, text string"))
    automaton = formats.automata["assign"]
    assert len(automaton.moves) > 60 and all(t < len(automaton.moves) for m in automaton.moves for t in m.values())
    found = {k: {s[:2] for s in formats.added(text, secrets.base_spans(text))} for k, text in test}
    missed = sum(bare[k] not in spans for k, spans in found.items())
    wrong = sum(len(spans - {bare[k]}) for k, spans in found.items())
    assert missed <= 20 and wrong <= 4  # of 400 credentials, and of 4000 look-alikes


def test_secrets_of_long_and_rare_formats_are_found(spark, monkeypatch):
    """Formats that no automaton holds, as values are long or other formats more frequent, find bare values too."""
    monkeypatch.setattr(secrets, "MOST_FORMATS", 3)
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("BCDFGHKLMNPQRSTVWXZbcdfghkmnpqrstvwxz23456789") for _ in range(n))
    makers = [lambda: f"9Z{some(598)}", lambda: "x_" + some(700), lambda: f"rare.{some(30)}.k9", *(lambda n=n: f"usual-{some(20 + n)}" for n in range(4))]
    train = [f"some plain words and token={makers[k]()} here" for k in (0, 1, 2, *([3, 4, 5] * 5), 6)]
    bare = {k: m() for k, m in enumerate(makers)}
    test = {k: f"now {v} stands alone, {some(640)} is longer by itself" for k, v in bare.items()}
    test[7] = f"null id has {bare[0]}/{bare[2]} in parts"
    formats = secrets.learn(spark.createDataFrame(list(enumerate(train)), "doc_id long, text string"))
    assert formats.rest and len(formats.automata["assign"].moves) < 100
    docs = spark.createDataFrame([*test.items(), (None, test[7]), (None, test[7]), (None, None)], "doc_id long, text string")
    got = [(r.doc_id, r.spans) for r in secrets.scan(docs, formats).collect()]
    parts = ",".join(f"format:{(a := test[7].index(v))}:{a + len(v)}" for v in (bare[0], bare[2]))
    assert sorted(got, key=str) == sorted([(k, f"format:4:{4 + len(v)}") for k, v in bare.items()] + [(7, parts), (None, parts), (None, parts), (None, "")], key=str)


def test_secrets_learn_from_every_document(spark):
    rare = F.concat(F.lit("key AKIA"), F.upper(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16)))
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 20_000 == 7, rare).otherwise(F.lit("a word")).alias("text"))
    formats = secrets.learn(docs)
    assert set(formats.automata) == {"access"}
    assert formats.ordinary["w"] == math.log((99_995 + 1) / (5 * 99_995 + 3 * 5 + len(secrets._VALUE)))


def test_inference_keeps_counts_and_merges_what_looks_alike():
    rng = random.Random(3)
    values = [secrets.symbols("key-" + "7" * rng.choice([6, 9]) + rng.choice(["", "-Q", "-Q="])) for _ in range(300)]
    merged = secrets.infer(values)
    assert sum(merged.ends) == 300 and sum(sum(t.values()) for t in merged.taken) == sum(len(secrets._steps(v)) for v in values)
    weighed = secrets.infer(Counter(values))
    assert (weighed.moves, weighed.taken, weighed.ends) == (merged.moves, merged.taken, merged.ends)
    assert merged.log_likelihood(secrets.symbols("key-777777-Q")) > -30 and merged.log_likelihood(secrets.symbols("key-7777")) == -math.inf
    counted = Counter(n for k in range(4000) for n in [1 + int(-math.log(1 - (k + 0.5) / 4000) * 4)])
    loop = secrets.infer(Counter({"0" * n: c for n, c in counted.items()}))  # lengths that fall off geometrically: one state and a loop
    assert len(loop.moves) < 8 and loop.log_likelihood("0" * 60) > -math.inf


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.word_bpe_path())
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["Alpha", "beta,", "γράμμα", "12x", "日本", "don't"]) for _ in range(rng.randint(0, 900)))) for k in range(150)]
    docs = odd.select("doc_id", "text").where("doc_id is not null and doc_id <> 9").unionByName(spark.createDataFrame([(k + 100, t) for k, t in rows], "doc_id long, text string"))
    got = packing.pack_documents(docs).collect()
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    at, sequences = {}, {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id]
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(own)
        piece = own[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece)) and len(piece) == r.length
        at[r.doc_id] = r.start + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {k: len(v) for k, v in ids.items()}
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.WINDOW
    assert packing.pack_documents(odd).count() >= 12 and packing.pack_documents(none).count() == 0


class Told:
    """A tokenizer that notes what it is asked for."""

    def __init__(self, tokenizer, told):
        self.tokenizer, self.told = tokenizer, told

    def encode_batch_fast(self, texts, **how):
        self.told += [w for t in texts for w in t.split()]
        return self.tokenizer.encode_batch_fast(texts, **how)


def test_letters_are_tokenized_once_whatever_marks_follow(monkeypatch):
    words = packing.WordCachedTokenizer(packing.word_bpe_path())
    plain, told = words.tokenizer, []
    for name in [k for k, v in vars(words).items() if isinstance(v, type(plain))]:
        monkeypatch.setattr(words, name, Told(getattr(words, name), told))
    texts = ["zanthery### zanthery, Zanthery!!! zanthery", "zanthery&&& über### über. ünter", "### ... zanthery\"?", "ünter: don't don'ts' x'_ _y 'll' q'll"]
    assert [list(ids) for ids in words.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(told) == sorted(set(told)) and sum("zanthery" in w for w in told) == sum("über" in w for w in told) == 1


def test_remembered_words_equal_the_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 300)
    words = packing.WordCachedTokenizer(packing.word_bpe_path())
    rng = random.Random(12)
    letters = "abcdeEÉßñıİªµɐжΩσ日本가ǅʼ0129²½.,;:!?'\"#%&_-–…€😀\u0301"
    for _ in range(40):
        texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) + rng.choice(["", ".", "##", "'s", "'"]) for _ in range(rng.randint(0, 40))) for _ in range(6)]
        assert [list(ids) for ids in words.encode(texts)] == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 512), min_size=1, max_size=80))
def test_windows_hold_everything_once(sizes):
    found = packing.windows_of(sizes, 1024)
    assert sorted(k for w in found for k in w) == list(range(len(sizes)))
    assert all(sum(sizes[k] for k in w) <= 1024 for w in found)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|>\\ns/[INST]im_endx\n ", max_size=40))
def test_escape_is_reversible(text):
    for f in (chat.escape, chat.escape_line):
        safe = f(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROLS)


def test_template_language():
    render = chat.compile_template("{% if 'a' == 'b' %}never{% elif x and not y %}{{ x + '!' | upper }}{% else %}no{% endif %}")
    assert "".join(t for t, _ in render({"x": "hi"})) == "hi!" and "".join(t for t, _ in render({})) == "no"
    assert chat.fold_constants(chat.parse("{{ 'a' + 'b' }}c{% if 1 %}d{% endif %}")) == chat.Node("list", (chat.Node("print", (chat.Node("const", ("abcd",)),)),))
    for bad in ("{{ x.__class__ }}", "{{ open('f') }}", "{% import os %}", "{% for a in b %}", "{{ x | nope }}", "{{ 'a }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>\n"), (1, 0, "user", None), (1, 1, "assistant", "b<|im_end|>\n"), (2, 0, None, "x"), (None, 0, "a\nb", "\\n"), (3, 0, "assistant", "l" * 200_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("clash"))
    got = {r.conv_id: r for r in chat.format_conversations(table).collect()}
    said = "user\n\n" + "assistant\nb<|im_end|>\n\n" * 2
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].n_turns == 3
    assert got[1].loss_sha256 == hashlib.sha256(b"b<|im_end|>\n" * 2).hexdigest() and got[3].loss_chars == 200_000
    assert got[None].turns_sha256 == hashlib.sha256(b"a\nb\n\\n\n").hexdigest()
    assert chat.format_conversations(table.limit(0)).count() == 0
