"""The ten operators and the pipeline against brute force, with the odd rows that each docstring defines."""

import collections
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semevra.llm import chat, decontamination, grouping, html, minhash, neighbours, packing, quality, sharding, substrings, toxicity
from semevra.llm import text as T

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("bcdfglmnprst") + RNG.choice("aeiou") for _ in range(RNG.randint(1, 4))) for _ in range(3000)]
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Clashing names: the columns that the operators use inside.
CLASH = ["id", "t", "k", "hash", "bucket", "label", "__h", "__keep", "__cuts", "n", "g", "path"]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def found(text):
    return re.findall(T.WORD_PATTERN, (text or "").lower())


def docs(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOC)
    return df.withColumns({c: F.lit("x") for c in CLASH})


ODD = [(None, "some words without an id " * 20), (901, None), (902, ""), (903, " .,;!\n"), (904, "é"), (905, "x" * 300_000), (906, "word " * 60_000)]


def test_words_match_the_regular_expression():
    texts = ["É a,b  c1!", None, "", "x" * 1_200_000 + " y", " İstanbul KK 'tis", prose(200), "ab\ncd"]
    w = T.words(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        want = found(t)
        got = w.hash[w.first[i] : w.first[i + 1]]
        assert len(got) == len(want)
        for x, h in zip(want, got):
            assert seen.setdefault(x, h) == h
        plain = T.words(pa.array([t]), hashes=False)
        raw = (t or "").encode()
        assert [raw[a:b].decode().lower() for a, b in zip(plain.start, plain.end)] == want
    assert len(set(seen.values())) == len(seen)


def test_words_in_windows_are_those_of_the_whole():
    rng = random.Random(100)
    w = T.WINDOW_BYTES
    texts = ["a" * (w - 1) + " b", "c" * w, "d" * (w + 1), "", "e" * (3 * w + 7) + " f", None, "g h " * w, "é" * w, *["x" * rng.randint(1, 9) for _ in range(50)]]
    every = T.words(pa.array(texts))
    for i, t in enumerate(texts):
        one = T.words(pa.array([t]))
        lo, hi = every.first[i], every.first[i + 1]
        assert (every.hash[lo:hi] == one.hash).all() and (every.start[lo:hi] == one.start).all() and (every.end[lo:hi] == one.end).all()
        assert len(one.hash) == len(found(t))
    # the hash of a word follows its letters alone, wherever a window ends in it
    a, b = T.words(pa.array(["z" * (2 * w + 5)])), T.words(pa.array([". " * 1000 + "z" * (2 * w + 5) + " y"]))
    assert a.hash[0] == b.hash[0] != b.hash[1]


def test_plain_words():
    texts = ["  É a,b -- C1! ", None, "", "x", "..", prose(300).upper()]
    raw, start, end, first = T.plain(pa.array(texts))
    for i, t in enumerate(texts):
        lo, hi = first[i], first[i + 1]
        assert [raw[a:z].tobytes().decode() for a, z in zip(start[lo:hi], end[lo:hi])] == found(t)
        if hi > lo:
            assert raw[start[lo] : end[hi - 1]].tobytes().decode() == " ".join(found(t))


def test_scratch_memory_does_not_follow_the_longest_text():
    import tracemalloc

    def peak(f, text):
        a = pa.array([text])
        tracemalloc.start()
        f(a)
        n = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return n / len(text)

    assert peak(T.words, "x" * 40_000_000) < 1
    text = "lorem ipsum dolor " * 1_000_000
    assert peak(T.words, text) < 8
    for f in (lambda a: minhash.signatures(T.words(a)), quality.statistics, lambda a: substrings.paths(T.words(a)), lambda a: decontamination.blocks(T.words(a))):
        assert peak(f, text) < 20


def test_grams_and_ranges_are_functions_of_the_words():
    h = T.mix(np.arange(300, dtype=np.uint64) % np.uint64(100))
    for n in (2, 8, 20, 50):
        g = T.grams(h, n)
        assert len(g) == 301 - n and (g[:100] == g[100:200]).all() and len(set(g[:100])) == 100
    a = T.range_hash(h, np.array([3, 103, 3]), np.array([9, 109, 10]))
    assert a[0] == a[1] != a[2]


# 1 ---------------------------------------------------------------------------------------------------------------------


def _page(rng):
    body = "".join(f"<p>{prose(rng.randint(20, 60), rng).capitalize()}.</p>" for _ in range(rng.randint(2, 6)))
    links = "".join(f"<li><a href='/{i}'>{prose(1, rng)}</a></li>" for i in range(6))
    return f"<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><ul>{links}</ul></nav><div class=ad>{prose(4, rng)}</div><article><h1>{prose(5, rng)}</h1>{body}</article><footer>&copy; {prose(4, rng)}</footer></body></html>"


def test_html_extraction_finds_the_article_of_held_out_pages(spark):
    rng = random.Random(1)
    rows = [(i, _page(rng)) for i in range(80)]
    train, held = rows[:60], rows[60:]
    model = html.fit(spark.createDataFrame(train, "page_id long, html string"))
    # without the semantic elements, which the model must not need
    plain = [(i, re.sub(r"(</?)(article|nav|footer)\b", r"\1section", h)) for i, h in held]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(plain, "page_id long, html string"), model).collect()}
    scores = []
    for i, h in held:
        want = collections.Counter(re.findall(r"\w+", re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*)</article>", h)[1])))
        have = collections.Counter(re.findall(r"\w+", got[i]))
        scores.append(2 * sum((want & have).values()) / (sum(want.values()) + sum(have.values())))
    assert np.mean(scores) > 0.95


def test_html_odd_pages(spark):
    rows = [
        (1, None), (2, ""), (3, "no tags < at all > &amp; 5"), (4, "<p>a<p>b<b>c<div>d"), (4, "<p>a<p>b<b>c<div>d"), (None, "<p>x</p>"),
        (6, "<div>" * 3000 + "deep"), (7, "<!-- open"), (8, "<p>" + "w " * 200_000)
    ]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({"k": F.lit(1), "h": F.lit(2), "text": F.lit("z")})
    model = html.fit(df)
    out = html.extract(df, model).collect()
    assert len(out) == len(rows) and out[0].text == "" and out[1].text == ""
    assert html.extract(df.limit(0), html.fit(df.limit(0))).count() == 0
    assert html.render(html.Page("<p>a<p>b <b>c</b><div>d&eacute;</div>")) == "a\nb c\ndé"


HOSTILE = [
    "<a " * 350_000, '<a x="' * 170_000, "<b>" * 150_000 + "</i>" * 150_000, "<b>" * 350_000, '<a ">" ' * 140_000 + '"',
    "<p><div>" + "<b>" * 100_000 + "<hr>" * 100_000, "<!" * 500_000, "<a " + "b" * 1_000_000 + ">", "<a " + "b " * 500_000 + ">", "<a " + "b='" * 300_000 + ">",
    "<" * 1_000_000, "<script>" * 120_000
]


@pytest.mark.parametrize("number", range(len(HOSTILE)))
def test_html_broken_pages_take_linear_time(number):
    began = time.process_time()
    page = html.Page(HOSTILE[number])
    x, own = html.features(page)
    html.labels(page)
    html.render(page, html.decode(page, np.zeros(len(x)), own))
    assert time.process_time() - began < 20


def test_html_tags_and_quotes():
    tags = lambda h: [(n, a.strip()) for n, _, a in html.pieces(h) if n]
    assert tags("<a href='x>y' b=\"<\">t</a>") == [("a", "href='x>y' b=\"<\""), ("a", "")]
    assert tags('<a b="c>d<i>e') == [("a", 'b="c'), ("i", "")]
    assert tags("1 < 2 <b <i>") == [("b", "<i")] and tags("<a") == [] and tags("<!-- <b> --><?x?><!y><c/>") == [("c", "/")]
    assert html._tokens("disabled class=\"Main nav\" id='x1' data-id=no role = menu y") == ["main", "nav", "x", "menu"]


def test_html_labels_come_from_elements_alone():
    page = html.Page("<body><div class=ad>x</div><div><article class=ad><p>a</p><nav>b</nav></article></div></body>")
    assert dict(zip(page.tag[1:], html.labels(page)[1:].tolist())) == {"body": -1, "div": -1, "article": 1, "p": 1, "nav": 1} | {"div": html.labels(page)[3]}
    assert html.labels(page)[2] == 0 and html.labels(html.Page("<div>a<nav>b</nav></div>")).tolist() == [-1, -1, 0]


def test_boosting_splits_where_brute_force_does():
    rng = np.random.default_rng(50)
    x = rng.integers(0, 6, (300, 4)).astype(float)
    y = ((x[:, 2] > 2) ^ (rng.random(300) < 0.15)).astype(float)
    model = html.Boosted(x, y)
    p = np.full(300, y.mean())
    g, h = y - p, p * (1 - p)
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max((gain(x[:, j] > c) + gain(x[:, j] <= c), j) for j in range(4) for c in range(5))
    feats, cuts, leaf = model.trees[0]
    j, c = int(feats[0]), model.cuts[int(feats[0])][cuts[0]]
    assert j == best[1] == 2 and abs(gain(x[:, j] > c) + gain(x[:, j] <= c) - best[0]) < 1e-9
    # leaves and scores, row by row
    score = np.full(300, model.base)
    for f, k, v in model.trees:
        for i in range(300):
            node = 0
            for d in range(html.DEPTH):
                at = (1 << d) - 1 + node
                cut = model.cuts[f[at]][k[at]] if k[at] < len(model.cuts[f[at]]) else np.inf
                node = node * 2 + int(x[i, f[at]] > cut)
            score[i] += v[node]
    assert np.allclose(score, model(x))
    loss = lambda s: np.log1p(np.exp(-np.where(y > 0, s, -s))).mean()
    assert loss(model(x)) < 0.75 * loss(np.full(300, model.base))


def test_html_decoding_is_consistent_and_optimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        page = html.Page("")
        page.tag, page.attrs = ["x"] * n, [""] * n
        parent = [-1]
        stack = [0]
        for i in range(1, n):
            stack = stack[: int(rng.integers(1, len(stack) + 1))]
            parent.append(stack[-1])
            stack.append(i)
        page.parent, page.last = parent, list(range(n))
        for i in range(n - 1, 0, -1):
            page.last[parent[i]] = max(page.last[parent[i]], page.last[i])
        own, score = rng.integers(0, 50, n).astype(float), rng.normal(0, 2, n)
        gain = np.clip(score, -6, 6) * np.log1p(own)

        def best(i):
            sub = gain[i : page.last[i] + 1].sum()
            kids = [j for j in range(n) if parent[j] == i]
            options = [sub, -sub]
            if kids:
                options.append(abs(gain[i]) - html.SPLIT_COST + sum(best(j) for j in kids))
            return max(options)

        keep = html.decode(page, score, own)
        value = sum(g if k else -g for g, k in zip(gain, keep))
        assert value >= best(0) - 1e-9


# 2 ---------------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out_and_odd_rows(spark):
    rng = random.Random(2)
    bad = ["mufsk", "zorga", "wexlo"]
    rows, marks = [], []
    for i in range(400):
        w = prose(rng.randint(20, 80), rng).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    labels = spark.createDataFrame(marks[:300] + [(None, 1), (5, None)], "doc_id long, toxic int")
    d = docs(spark, rows + ODD + rows[:2])
    model = toxicity.fit(d, labels)
    out = toxicity.score(d, *model).collect()
    assert len(out) == len(rows) + len(ODD) - 1 + 2
    held = {r.doc_id: r.toxic for r in out if 300 <= (r.doc_id or 0) < 400}
    assert sum(held[i] == (i % 4 == 0) for i in held) >= 98
    clean = {r.doc_id: r.toxic for r in out if r.doc_id and r.doc_id > 900}
    assert not clean[901] and not clean[902]
    assert (model[0] != 0).sum() < 2000
    empty = toxicity.fit(d.limit(0), labels)
    assert not empty[0].any() and toxicity.score(d.limit(0), *empty).count() == 0


def test_ftrl_against_the_formulas_one_coordinate_at_a_time():
    rng = np.random.default_rng(80)
    rows = [np.unique(rng.integers(0, 32, rng.integers(0, 9))).astype(np.int32) for _ in range(120)]
    y = (rng.random(120) < 0.4).astype(float)
    alpha, beta, l1, l2 = 0.3, 1.0, 1.5, 1.0
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i, cut):
        return 0.0 if abs(z[i]) <= cut else -(z[i] - math.copysign(cut, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for x, t in zip(rows, y):
            w = {i: weight(i, l1) for i in x.tolist()} | {"bias": weight("bias", 0.0)}
            g = 1 / (1 + math.exp(-sum(w.values()))) - t
            for i, v in w.items():
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * v
                n[i] += g * g
    got, bias = toxicity.ftrl(rows, y, 5, alpha, beta, l1, l2, 3)
    assert np.allclose(got, [weight(i, l1) for i in range(32)]) and abs(bias - weight("bias", 0.0)) < 1e-12
    assert 0 < (got == 0).sum() < 32  # the penalty leaves some out


def test_toxicity_query_against_brute_force(spark, tmp_path):
    from semevra.llm import queries

    rng = random.Random(81)
    rows = [(i, " ".join([*prose(30, rng).split(), *(["zorga", "mufsk"] if i % 3 == 0 else [])])) for i in range(150)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.toxicity for r in queries.op2_toxicity(spark, str(tmp_path)).collect()}
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    order = [r.doc_id for r in d.filter("doc_id < 100").orderBy(F.xxhash64("doc_id", "text")).select("doc_id").collect()]
    text = dict(rows)
    sets = lambda t: np.unique(toxicity.features(T.words(pa.array([t])))[0])
    xs, y = [sets(text[i]) for i in order], np.array([float(i % 3 == 0) for i in order])
    w, b = toxicity.ftrl(xs, y)
    b -= toxicity.cut_point(xs, y, toxicity.BITS)
    score = {i: 1 / (1 + math.exp(-(float(w[sets(t)].astype(np.float32).sum()) + b))) for i, t in rows}
    assert set(got) == {i for i, s in score.items() if s >= 0.5} and len(got) >= 45
    assert all(abs(got[i] - score[i]) < 1e-4 for i in got)


def test_toxicity_score_is_the_sum_of_distinct_feature_weights(spark):
    w = np.zeros(1 << 10, np.float32)
    w[:] = np.random.default_rng(0).normal(0, 0.2, 1 << 10)
    text = prose(50) + " " + prose(3) * 2
    idx = set(toxicity.features(T.words(pa.array([text])), 10)[0].tolist())
    want = 1 / (1 + math.exp(-(sum(float(w[i]) for i in idx) - 1)))
    got = toxicity.score(docs(spark, [(1, text)]), w, -1.0).first()
    assert abs(got.toxicity - want) < 1e-4


# 3 ---------------------------------------------------------------------------------------------------------------------


def test_templates():
    run = lambda t, **d: chat.compile_template(t)(d)
    assert run("a{{ 1 + 2 * 3 }}b{# c #}{{ 'x' ~ none }}")[0] == "a7bx"
    assert run("{% for x in xs %}{{ loop.index }}{{ x.a | upper }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"a": "p"}, {"a": "q"}])[0] == "1P,2Q"
    text, spans = run("u{% generation %}{{ a }}{% endgeneration %}v{% generation %}w{% endgeneration %}", a="xyz")
    assert text == "uxyzvw" and [text[a:b] for a, b in spans] == ["xyz", "w"]
    assert run("{% if a == 1 %}1{% elif a in [] %}2{% else %}3{% endif %}".replace("[]", "'abc'"), a="b")[0] == "2"
    assert run("{{ a.__class__ }}{{ missing.x }}{{ a['y'] | default('d') }}{{ b is defined }}", a={"x": 1})[0] == "dfalse"
    assert run("x \n {%- set y = 'q' -%} \n {{ y }}")[0] == "xq"
    for bad in ("{% for %}{% endfor %}", "{% if x %}", "{{ f(1) }}", "{{ 'a' | nothing }}", "{{ 1 + }}", "{% nope %}", "{{ not }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_constants_fold():
    tree = chat.fold(chat.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}no{% else %}d{% endif %}{{ x }}"))
    assert tree == ("block", ("text", ("const", "abCd")), ("text", ("name", "x")))


def test_chats_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (2, 0, "user", "x" * 100_000), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("m", F.lit(1))
    out = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert set(out) == {1, 2} and out[1].n_turns == 3
    assert out[1].rendered == "<|im_start|>user\na<|im_end|>\n" + "<|im_start|>assistant\nb<|im_end|>\n" * 2
    marks = [tuple(map(int, x.split("-"))) for x in out[1].generation.split(",")]
    assert [out[1].rendered[a:b] for a, b in marks] == ["b<|im_end|>"] * 2
    assert out[2].rendered.startswith("<|im_start|>\n<|im_end|>\n") and out[2].generation == ""
    assert chat.format_chats(df.limit(0)).count() == 0
    prompt = chat.CHATML + "{{ eos }}{% if add_generation_prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}"
    with_prompt = {r.conv_id: r.rendered for r in chat.format_chats(df, prompt, True, {"eos": "</s>", "messages": "hidden"}).collect()}
    assert with_prompt == {k: r.rendered + "</s><|im_start|>assistant\n" for k, r in out.items()}
    assert {r.rendered for r in chat.format_chats(df, prompt).collect()} == {r.rendered for r in out.values()}


# 4 and 10 --------------------------------------------------------------------------------------------------------------


def _least(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {x: root(x) for x in up if root(x) != x}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, 500)]
    got = {r.id: r.label for r in grouping.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k != v} == _least(pairs) and got[500] == 500
    assert grouping.components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError, match="settled"):
        grouping.components(spark.createDataFrame(pairs, "a long, b long"), rounds=0)


def test_contracted_pieces_keep_their_components():
    rng = np.random.default_rng(43)
    for n in (1, 5, 60, 2000):
        a, b = rng.integers(0, n, n), rng.integers(0, n, n)
        x, y = grouping.contract(a, b)
        assert dict(zip(x.tolist(), y.tolist())) == _least(list(zip(a.tolist(), b.tolist())))
    assert len(grouping.contract(np.arange(99), np.arange(1, 100))[0]) == 99 and not len(grouping.contract(np.zeros(0, int), np.zeros(0, int))[0])


def test_components_of_many_pieces(spark):
    rng = random.Random(44)
    pairs = [(i, i + 1) for i in range(0, 3000)] + [(rng.randrange(10_000, 14_000), rng.randrange(10_000, 14_000)) for _ in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r.label for r in grouping.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {k: v for k, v in got.items() if k != v} == _least(pairs)


def test_crowded_buckets_are_split_before_they_are_squared(spark, monkeypatch):
    monkeypatch.setattr(grouping, "HOT", 8)
    b = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 0), (2, 50)], "bucket long, id long")
    none = spark.createDataFrame([], "id long, label long")
    finer = lambda rows, depth: rows.select((F.col("bucket") * 100 + F.floor(F.col("id") / 4)).alias("bucket"), "id")
    got = {tuple(r) for r in grouping.cross_pairs(b, none, finer).collect()}
    assert got == {(x, y) for x in range(40) for y in range(x + 1, 40) if x // 4 == y // 4} | {(0, 50)}
    # what no split parts is compared in full
    got = grouping.cross_pairs(b, none, lambda rows, depth: rows).count()
    assert got == 40 * 39 // 2 + 1
    # and near copies are found all the same
    monkeypatch.setattr(grouping, "HOT", 2)
    rng = random.Random(45)
    base = prose(80, rng)
    rows = [(i, _near(base, 0.12, rng)) for i in range(30)] + [(100 + i, prose(80, rng)) for i in range(20)]
    sets = [(i, frozenset(zip(*[found(t)[k:] for k in range(3)]))) for i, t in rows]
    want = _least([(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if len(s & t) / len(s | t) >= minhash.THRESHOLD])
    got = {r.doc_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got <= set(want) and len(got) >= 0.95 * len(want)


@pytest.mark.parametrize("at_once", [0, grouping.AT_ONCE])
def test_near_copies_in_pieces_cost_a_few_comparisons_each(spark, monkeypatch, at_once):
    """Pairs of near copies that are closest to each other, and one bucket that holds all: it is not squared once its centre is compared."""
    monkeypatch.setattr(grouping, "AT_ONCE", at_once)
    n = 400
    rows = [(i // 2, i) for i in range(n)] + [(-1, i) for i in range(n)] + [(-2, n), (-2, n + 1), (-2, 0)]
    seen = {"sieved": 0, "verified": 0}

    def sieve(pairs):
        seen["sieved"] += pairs.count()
        return pairs.withColumn("est", F.when((F.floor(F.col("a") / 2) == F.floor(F.col("b") / 2)), 160).otherwise(100))

    def verify(pairs):
        seen["verified"] += pairs.count()
        return pairs.filter(f"b < {n}")

    none = spark.createDataFrame([], "a long, b long")
    labels = grouping.group(spark.createDataFrame(rows, "bucket long, id long"), sieve, verify, none, lambda rows, depth: rows)
    got = {r.id: r.label for r in labels.collect()}
    assert {got.get(i) for i in range(n)} == {0} and got.get(n, n) == n and got.get(n + 1, n + 1) == n + 1
    assert seen["sieved"] < 10 * n and seen["verified"] < 10 * n


def test_grouping_in_rounds_finds_the_components_of_all_true_pairs(spark, monkeypatch):
    """Against brute force, with further centres and rounds at every size, and true pairs that only cross pairs show."""
    monkeypatch.setattr(grouping, "AT_ONCE", 0)
    rng = np.random.default_rng(3)
    for ahead, few in ((0, 0), (1 << 22, 16)):
        monkeypatch.setattr(grouping, "AHEAD", ahead)
        monkeypatch.setattr(grouping, "FEW", few)
        rows = sorted({(int(x), int(i)) for x, i in zip(rng.integers(0, 12, 150), rng.integers(0, 60, 150))})
        true = {(int(min(p)), int(max(p))) for p in rng.integers(0, 60, (60, 2)) if p[0] != p[1]}
        shared = {(a, b) for x, a in rows for y, b in rows if x == y and a < b}
        at = list(range(60))
        for _ in range(60):
            for a, b in true & shared:
                at[a] = at[b] = min(at[a], at[b])
        good = spark.createDataFrame(sorted(true), "a long, b long")
        got = grouping.group(
            spark.createDataFrame(rows, "bucket long, id long"), lambda p: p.withColumn("est", F.pmod(F.xxhash64("a", "b"), F.lit(9)).cast("int")),
            lambda p: p.join(good, ["a", "b"], "left_semi"), spark.createDataFrame([], "a long, b long"), lambda rows, depth: rows
        )
        assert {r.id: r.label for r in got.filter("id <> label").collect()} == {i: x for i, x in enumerate(at) if i != x}


def test_pairs_of_a_bucket_in_blocks_and_tiles(spark, monkeypatch):
    """Every two rows of a bucket meet once, at any size of blocks, tiles and batches; exact sizes of intersections."""
    monkeypatch.setattr(grouping, "TILE", 5)
    rng = np.random.default_rng(8)
    rows = [(int(x), i) for i, x in enumerate(rng.integers(0, 4, 60))]
    want = sorted((a, b) for x, a in rows for y, b in rows if x == y and a < b)
    for block in (1, 7, 1000):
        monkeypatch.setattr(grouping, "BLOCK", block)
        cut = grouping.blocks(spark.createDataFrame(rows, "bucket long, id long")).sort("bucket", "low", "high", "side").toArrow().combine_chunks()
        got = []
        for t, part, both in grouping.whole_parts(cut.slice(k, 9).combine_chunks().to_batches()[0] for k in range(0, len(cut), 9)):
            ids = t.column("id").to_numpy()
            for i, j in grouping.tiles(part, both, t.column("side").to_numpy()):
                got += [tuple(sorted(p)) for p in zip(ids[i].tolist(), ids[j].tolist())]
        assert sorted(got) == want
    sets = [sorted({int(x) for x in rng.integers(0, 30, n)}) for n in (0, 1, 5, 20, 40)]
    i, j = np.divmod(np.arange(25), 5)
    n = minhash.intersections([np.array(x, np.uint64).tobytes() for x in sets], i, j)
    assert n.tolist() == [len(set(sets[a]) & set(sets[b])) for a, b in zip(i, j)]



def test_shared_buckets(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(40), rng.randrange(6)) for _ in range(80)] + [(77, 1), (77, 1)]
    by = collections.defaultdict(set)
    for b, i in rows:
        by[b].add(i)
    want = sorted((b, i) for b, s in by.items() if len(s) > 1 for i in s)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, grouping.shared(spark.createDataFrame(rows, "bucket long, id long")).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_hot_buckets_are_spread(spark, monkeypatch):
    rng = random.Random(61)
    rows = [(rng.randrange(300), rng.randrange(5)) for _ in range(300)] + [(b, i) for b in (901, 902) for i in range(400)] + [(901, 7)] * 3
    rng.shuffle(rows)
    by = collections.defaultdict(set)
    for b, i in rows:
        by[b].add(i)
    want = sorted((b, i) for b, s in by.items() if len(s) > 1 for i in s)
    df = spark.createDataFrame(rows, "bucket long, id long").repartition(3)
    assert sorted(map(tuple, grouping.shared(df).collect())) == want
    for name, value in (("SPREAD", 300), ("COUNTED", 100), ("SEEN", 5)):
        monkeypatch.setattr(grouping, name, value)
    got = grouping.shared(df)
    assert sorted(map(tuple, got.collect())) == want
    assert "LeftSemi" in got._jdf.queryExecution().executedPlan().toString()


def _near(text, share, rng):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else w for w in text.split())


def test_minhash_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng.randint(5, 150), rng)) for i in range(120)]
    for i in range(60):
        rows.append((200 + i, _near(rows[rng.randrange(120)][1], rng.choice([0, 0.02, 0.05, 0.3]), rng)))
    rows += [(300 + i, _near(rows[0][1], 0.03, rng)) for i in range(25)] + [(400, "short"), (401, "Short!"), (402, "shorter"), (120, rows[5][1])] + ODD + [(907, " .")]
    sets = [(i, frozenset(zip(*[w[k:] for k in range(3)])) if len(w) >= 3 else frozenset([tuple(w)])) for i, t in rows if i is not None and (w := found(t))]
    pairs = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if a != b and len(s & t) / len(s | t) >= minhash.THRESHOLD]
    want = _least(pairs)
    got = {r.doc_id: r.kept_doc_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert not set(got) - set(want)
    assert len(got) >= 0.97 * len(want) and 401 in got and 402 not in got
    assert minhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_bayesian_bound():
    least = minhash.least_matches(0.5, 0.005)
    rng = np.random.default_rng(8)
    p = (1 + 255 * 0.55) / 256
    places = minhash.BANDS * minhash.ROWS
    ends = range(minhash.BATCH, places + 1, minhash.BATCH)
    assert len(least) == len(ends)
    seen = rng.random((20_000, places)) < p
    passed = np.all([seen[:, :n].sum(1) >= m for n, m in zip(ends, least)], axis=0)
    assert passed.mean() > 0.97
    low = rng.random((20_000, places)) < (1 + 255 * 0.2) / 256
    assert np.all([low[:, :n].sum(1) >= m for n, m in zip(ends, least)], axis=0).mean() < 0.01


def test_sets_that_share_a_mark_are_compared(spark):
    rng = random.Random(41)
    rows = [(i, prose(60, rng)) for i in range(40)]
    rows += [(100 + i, rows[i][1].upper()) for i in range(20)] + [(200, rows[3][1]), (3, rows[30][1])]
    sets = [(i, frozenset(zip(*[found(t)[k:] for k in range(3)]))) for i, t in rows]
    want = _least([(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if a != b and s == t])
    for bits in (64, 3):
        got = {r.doc_id: r.kept_doc_id for r in minhash.near_duplicates(docs(spark, rows), mark_bits=bits).collect()}
        assert got == want, bits


def test_exact_jaccard():
    rng = random.Random(42)
    pairs = [
        (" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))), " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30)))) for _ in range(300)
    ] + [(None, "a b c"), ("x y z " * 9000, "x y z " * 10), ("a", "a"), ("", "")]
    shingled = lambda t: {tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))} if (w := found(t)) else set()
    got = minhash.jaccard(T.words(pa.array([a for a, _ in pairs])), T.words(pa.array([b for _, b in pairs])))
    for (a, b), j in zip(pairs, got):
        x, y = shingled(a), shingled(b)
        assert abs(j - len(x & y) / max(1, len(x | y))) < 1e-12


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 32))
    near = base[rng.integers(0, 300, 120)] + rng.normal(size=(120, 32)) * rng.choice([0.05, 0.15, 0.3, 0.6], (120, 1))
    x = np.vstack([base, near, base[:3], base[:1] * 7]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [
        (900, None, 1), (901, [], 1), (902, [0.0] * 32, 1), (903, [float("nan")] * 32, 1), (904, [1.0, None], 1), (None, rows[0][1], 1), (905, [1.0, 2.0], 1),
        (906, [1.0, 2.0], 1), (7, rows[7][1], 1)
    ]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u.astype(np.float64) @ u.T
    pairs = [(a, b) for a, b in zip(*np.nonzero(np.triu(c, 1) >= neighbours.THRESHOLD))] + [(905, 906)]
    want = _least([(int(a), int(b)) for a, b in pairs])
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, id int").withColumn("v", F.lit(1))
    got = {r.vec_id: r.kept_vec_id for r in neighbours.near_duplicates(df).collect()}
    assert not set(got) - set(want) and len(got) >= 0.9 * len(want) and 906 in got
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_units_and_signs_against_plain_numpy():
    rows = [[3.0, 4.0], None, [], [0.0, 0.0], [1.0, None], [float("inf"), 1.0], [float("nan")], [1e30, 1e30, 0.0], [5.0], [1.0, 2.0]]
    keep, packed_ = neighbours.units(pa.array(range(len(rows)))[2:], pa.array(rows, pa.list_(pa.float32()))[2:])
    assert keep.to_pylist() == [7, 8, 9]
    got = [np.frombuffer(x, np.float32).tolist() for x in packed_.to_pylist()]
    assert np.allclose(got[0], [0.5**0.5, 0.5**0.5, 0]) and got[1] == [1.0] and np.allclose(got[2], np.array([1, 2]) / 5**0.5)
    rng = np.random.default_rng(46)
    x = rng.normal(size=(50, 16)).astype(np.float32)
    x[1] = x[0]
    x[2] = -x[0]
    (part, key), = neighbours.signs(np.arange(50), neighbours.packed(x.ravel(), np.full(50, 16)), 11, 7, {})
    planes = np.random.Generator(np.random.PCG64(16)).standard_normal((16, 77), dtype=np.float32)
    on = (x @ planes > 0).reshape(50, 7, 11)
    same = (on[:, None] == on[None]).all(3)
    assert ((key[:, None] == key[None]) == same).all() and len(part) == 50


# 5 ---------------------------------------------------------------------------------------------------------------------


def _differences(sizes, k):
    """Karmarkar-Karp as in the textbook, on sums alone."""
    parts = [sorted([s] + [0] * (k - 1), reverse=True) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
    return parts[0]


def test_sharding_balances_like_the_textbook(spark):
    rng = random.Random(10)
    sizes = [rng.randint(1, 5000) for _ in range(60)]
    df = spark.createDataFrame([(f"g{i:02}", s) for i, s in enumerate(sizes)], "g string, bytes long")
    out = sharding.assign_groups(df, 4).collect()
    sums = collections.Counter()
    for r in out:
        sums[r.shard] += r.bytes
    best = _differences(sizes, 4)
    assert max(sums.values()) - min(sums.values()) <= max(best[0] - best[-1], 8)
    tree = sharding.assign_groups(df, 4, block=16).collect()
    assert sorted(r.g for r in tree) == sorted(r.g for r in out)
    sums = collections.Counter()
    for r in tree:
        sums[r.shard] += r.bytes
    assert max(sums.values()) < 1.05 * sum(sizes) / 4
    for seed, block in ((1, 16), (2, 20), (3, 1000)):
        rng = random.Random(seed)
        sizes = [int(1000 / rng.random()) for _ in range(200)]
        df = spark.createDataFrame([(f"g{i:03}", s) for i, s in enumerate(sizes)], "g string, bytes long")
        sums = collections.Counter({k: 0 for k in range(4)})
        for r in sharding.assign_groups(df, 4, block=block).collect():
            sums[r.shard] += r.bytes
        assert max(sums.values()) - min(sums.values()) <= max(sizes)


def test_shard_odd_rows(spark):
    rows = [(i, "abc" * i, None if i % 5 == 0 else "en", f"s{i % 3}", 0) for i in range(30)] + [(None, None, None, None, None), (1, "abc", "en", "s1", 0)]
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("x") for c in ("g", "bytes", "shard")})
    out = sharding.shard(df, 4).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(set)
    where = {r.doc_id: r.shard for r in out}
    for i, _, lang, source, _ in rows[:30]:
        by[lang, source].add(where[i])
    assert all(len(s) == 1 for s in by.values())
    assert sharding.shard(df.limit(0), 4).count() == 0


# 6 ---------------------------------------------------------------------------------------------------------------------


def test_quality_held_out_and_odd_rows(spark):
    rng = random.Random(11)
    rows, marks = [], []
    for i in range(300):
        good = i % 3 > 0
        t = ". ".join(prose(9, rng).capitalize() for _ in range(6))
        rows.append((i, t if good else t.upper().replace(" ", "!! ")))
        marks.append((i, int(good)))
    d = docs(spark, rows + ODD).withColumn("source", F.concat(F.lit("h"), F.col("doc_id") % 7)).withColumn("lang", F.when(F.col("doc_id") % 11 > 0, "en"))
    model = quality.fit(d, spark.createDataFrame(marks[:200] + [(None, 1), (3, None)], "doc_id long, quality int"))
    out = quality.judge(d, model).collect()
    assert len(out) == len(rows) + len(ODD)
    held = {r.doc.doc_id: r.keep for r in out if r.doc.doc_id is not None and 200 <= r.doc.doc_id < 300}
    assert sum(held[i] == (i % 3 > 0) for i in held) >= 97
    assert quality.judge(d.limit(0), model).count() == 0
    assert quality.judge(d, quality.fit(d.limit(0), spark.createDataFrame([], "doc_id long, quality int"))).count() == len(out)


def test_posteriors_shrink_as_the_formulas_say(spark):
    rng = np.random.default_rng(12)
    rows, docs_ = [], []
    for h in range(6):
        for p in range(4):
            n = int(rng.integers(1, 60))
            x = np.clip(rng.normal(0.2 + 0.1 * h + 0.04 * p, 0.1, n), 0, 1)
            docs_ += [(h, p, v) for v in x]
            rows.append((f"h{h}", f"p{p}", float(n), float(x.sum()), float((x * x).sum())))
    got = {(r.host, r.path): r for r in quality.posteriors(spark.createDataFrame(rows, "host string, path string, n double, s double, ss double")).collect()}
    v = np.array([d[2] for d in docs_])
    host = np.array([d[0] for d in docs_])
    both = np.array([d[0] * 4 + d[1] for d in docs_])
    n, mu = len(v), v.mean()
    group = lambda k: {g: v[k == g] for g in np.unique(k)}
    within = sum(((x - x.mean()) ** 2).sum() for x in group(both).values()) / (n - len(group(both)))
    hs = group(host)
    tau = (sum(len(x) * (x.mean() - mu) ** 2 for x in hs.values()) - 5 * within) / (n - sum(len(x) ** 2 for x in hs.values()) / n)
    kh = within / tau
    for h, x in hs.items():
        assert abs(got[f"h{h}", "p0"].host_quality - (x.sum() + kh * mu) / (len(x) + kh)) < 1e-6
    k = both
    mean_in = sum(len(x) * (x.mean() - hs[int(c) // 4].mean()) ** 2 for c, x in group(k).items())
    tau = (mean_in - (24 - 6) * within) / (n - sum(sum((k == c).sum() ** 2 for c in np.unique(k[host == h])) / len(x) for h, x in hs.items()))
    kp = within / tau
    assert len(got) == 24
    for c, x in group(k).items():
        r = got[f"h{int(c) // 4}", f"p{int(c) % 4}"]
        assert abs(r.path_quality - (x.sum() + kp * r.host_quality) / (len(x) + kp)) < 1e-6


def test_quality_query_against_brute_force(spark, tmp_path):
    from semevra.llm import queries

    rng = random.Random(82)
    rows, labels = [], []
    for i in range(240):
        t = ". ".join(prose(9, rng).capitalize() for _ in range(5))
        good = rng.random() < (0.9 if i % 4 else 0.3)
        rows.append((i, t if good else t.upper().replace(" ", "!! "), f"l{i % 3}", f"s{i % 4}", 0))
        labels.append((i, int(good), 0))
    rows.append((900, rows[1][1], "alone", "alone", 0))
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels[:120], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op6_quality(spark, str(tmp_path)).collect()}
    x = quality.statistics(pa.array([r[1] for r in rows]))
    y = np.array([float(lab[1]) for lab in labels[:120]])
    mean, scale, b = quality.logistic(x[:120], y)
    logit = np.clip(np.clip((x - mean) / scale, -8, 8) @ b[:-1] + b[-1], -12, 12)
    p = 1 / (1 + np.exp(-logit))
    prior = math.log(y.mean() / (1 - y.mean()))
    sites = {
        r[:2]: r for r in quality.posteriors(
            spark.createDataFrame(
                [
                    (h, q, float(len(v)), float(v.sum()), float((v * v).sum())) for (h, q), v in (
                        (k, np.array([p[i] for i, r in enumerate(rows) if (r[3], r[2]) == k])) for k in {(r[3], r[2]) for r in rows}
                    )
                ],
                "host string, path string, n double, s double, ss double"
            )
        ).collect()
    }
    keep = set()
    for i, r in enumerate(rows):
        own = [j for j, q in enumerate(rows) if q[3] == r[3] and j != i]
        site = [j for j in own if rows[j][2] == r[2]]
        s = sites[r[3], r[2]]
        h = (p[own].sum() + s.kh * s.mu) / (len(own) + s.kh)
        q = np.clip((p[site].sum() + s.kp * h) / (len(site) + s.kp), 1e-4, 1 - 1e-4)
        v = 1 / (1 + math.exp(-(logit[i] - prior + math.log(q / (1 - q)))))
        if v >= 0.5:
            keep.add(r[0])
            assert abs(got[r[0]].quality - v) < 1e-4, (r[0], v)
    assert set(got) == keep and 100 < len(keep) < 230


# 7 ---------------------------------------------------------------------------------------------------------------------


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_bit_parallel_subsequences():
    rng = np.random.default_rng(13)
    target = decontamination.Target(np.arange(20), T.Words(rng.integers(0, 30, 20 * 40).astype(np.uint64), np.arange(21) * 40, None, None))
    a, z, vocabulary, mask = target.groups()[0]
    tokens = rng.integers(0, len(vocabulary) + 1, (200, 128))
    seg = rng.integers(0, 20, 200)
    lcs, head = decontamination.subsequences(mask, seg, tokens, target.size[seg])
    for i in range(0, 200, 7):
        words = [int(vocabulary[t]) if t < len(vocabulary) else -1 for t in tokens[i]]
        item = [int(x) for x in target.hash[seg[i]]]
        assert lcs[i] == _lcs(item, words) and head[i] == _lcs(item[:30], words)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(14)
    items = [(i, prose(rng.randint(16, 60), rng)) for i in range(30)] + [(90, None), (91, ""), (92, "a b c"), (93, prose(150, rng)), (None, prose(20, rng))]
    rows = [(i, prose(rng.randint(5, 400), rng)) for i in range(300)]
    want = set()
    for i in range(40):
        item = rng.choice(items[:30] + [items[33]])
        w = prose(rng.randint(0, 300), rng).split()
        at = rng.randint(0, len(w))
        leak = item[1].split() if i % 2 else _near(item[1], 0.1, rng).split()
        rows.append((1000 + i, " ".join(w[:at] + leak + w[at:])))
        want.add((1000 + i, item[0]))
    d = docs(spark, rows + ODD + rows[-2:])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("i", F.lit("x"))
    got = {(r.doc_id, r.item_id): r.share for r in decontamination.leaks(d, bench).collect()}
    assert not set(got) - want and len(got) >= 0.9 * len(want)
    whole = {w for w in want if w[0] % 2}
    assert whole <= set(got) and all(got[w] == 1.0 for w in whole)
    assert decontamination.leaks(d.limit(0), bench).count() == 0 and decontamination.leaks(d, bench.limit(0)).count() == 0


def test_rare_words_end_pairs_before_they_are_looked_at(monkeypatch):
    """The bound by blocks loses no pair, at any length of texts, and passages without rare words cost no look at their words."""
    rng = random.Random(15)
    items = [prose(rng.randint(8, 90), rng) for _ in range(150)]
    texts = [prose(rng.choice([1, 5, 20, 40, 300, 3000]), rng) for _ in range(200)] + ["", None]
    for i in range(80):
        w = prose(rng.choice([0, 3, 30, 200]), rng).split()
        texts.append(" ".join(w[: len(w) // 2] + _near(rng.choice(items), 0.1, rng).split() + w[len(w) // 2 :]))
    rng.shuffle(texts)
    w, b = T.words(pa.array(texts)), T.words(pa.array(items))
    idf = np.random.default_rng(16).random(1 << decontamination.BITS).astype(np.float32) + 1
    table = decontamination.with_zero(np.random.default_rng(17).standard_normal((1 << decontamination.BITS, 64)).astype(np.float32) * idf[:, None])
    target = decontamination.Target(np.arange(len(items)), b)
    rest = target.vectors(table), target.groups(), target.least(idf, decontamination.COSINE), target.rare(idf)
    assert len(rest[1]) > 1
    sort = lambda found: sorted(zip(*(x.tolist() for x in found)))
    got = sort(decontamination.search(w, table, target, *rest))
    monkeypatch.setattr(decontamination.Rare, "count", lambda self, h, block, blocks: np.full((blocks, self.width), 99))
    assert got == sort(decontamination.search(w, table, target, *rest)) and len({t for t, _, _ in got}) >= 60
    monkeypatch.undo()
    monkeypatch.setattr(decontamination, "slot", None)
    other = T.words(pa.array([" ".join(f"{i}x{j}" for j in range(500)) for i in range(20)]))
    assert not len(decontamination.search(other, table, target, *rest)[0])


def test_short_items_are_found_word_for_word(spark):
    rng = random.Random(31)
    items = [(1, "What is the capital of France?"), (2, "yes"), (3, "Paris, of course"), (4, prose(150, rng)), (5, "what is the capital of"), (6, None), (7, " ?!")]
    rows = [(i, prose(200, rng)) for i in range(60)]
    rows += [
        (100, prose(90, rng) + " what IS the\ncapital of France " + prose(90, rng)), (101, "paris of"), (102, "course"), (103, "Yes"),
        (104, prose(30, rng) + " " + items[3][1]), (105, "what is the capital of"), (106, "paris of the course")
    ]
    found_ = lambda b: {(r.doc_id, r.item_id) for r in decontamination.leaks(docs(spark, rows), spark.createDataFrame(b, "item_id long, text string")).filter("share = 1").collect()}
    want = {(100, 1), (100, 5), (103, 2), (104, 4), (105, 5)}
    assert found_(items) == want
    assert found_([i for i in items if i[0] != 4]) == want - {(104, 4)}


def test_altered_items_of_every_length_pass_the_gate(spark):
    rng = random.Random(32)
    items, rows = [], [(i, prose(300, rng)) for i in range(100)]
    for k, n in enumerate(n for n in (8, 10, 12, 16, 24) for _ in range(30)):
        w = prose(n, rng).split()
        items.append((k, " ".join(w)))
        for j in rng.sample(range(n - max(n // 4, 2)), int(0.28 * n)):
            w[j] = rng.choice(VOCABULARY)
        rows.append((1000 + k, f"{prose(rng.randint(40, 90), rng)} {' '.join(w)} {prose(90, rng)}"))
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    shares = [np.mean([(1000 + k, k) in got for k in range(a, a + 30)]) for a in range(0, 150, 30)]
    assert min(shares) >= 0.9, shares


def test_items_of_common_words_are_found(spark):
    rng = random.Random(90)
    common = VOCABULARY[:20]
    # every block holds all the common words, in the wrong order, so none of them carries weight
    rows = [(i, " ".join(x for _ in range(6) for x in [*reversed(common), *prose(12, rng).split()])) for i in range(80)]
    w = list(common)
    w[3], w[9] = "unheard", "of"
    rows.append((500, f"{rows[0][1]} {' '.join(w)} {rows[1][1]}"))
    got = decontamination.leaks(docs(spark, rows), spark.createDataFrame([(1, " ".join(common))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(500, 1)] and got[0].share == 0.9


def test_long_items_match_where_their_answer_is(spark):
    rng = random.Random(91)
    item = prose(150, rng).split()
    rows = [(i, prose(300, rng)) for i in range(60)]
    question, answer = _near(" ".join(item[:100]), 0.05, rng), _near(" ".join(item[80:]), 0.05, rng)
    rows += [
        (500, f"{prose(50, rng)} {question} {prose(50, rng)}"), (501, f"{prose(50, rng)} {answer} {prose(50, rng)}"), (502, " ".join(item)),
        (503, _near(" ".join(item), 0.1, rng))
    ]
    got = {r.doc_id for r in decontamination.leaks(docs(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {501, 502, 503}


def test_a_large_benchmark_takes_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PASS_BYTES", 700)
    rng = random.Random(92)
    items = [(i, prose(rng.choice([3, 20, 40]), rng)) for i in range(20)]
    rows = [(i, prose(200, rng)) for i in range(40)] + [(100 + i, f"{prose(30, rng)} {t} {prose(30, rng)}") for i, t in items]
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(100 + i, i) for i, _ in items}


def test_nystrom_finds_the_leading_space():
    rng = np.random.default_rng(15)
    a = rng.normal(size=(400, 8)) * np.array([9, 8, 7, 6, 5, 4, 3, 2.0]) @ rng.normal(size=(8, 60)) + rng.normal(size=(400, 60)) * 0.01
    omega = rng.normal(size=(60, 20))
    u, s = decontamination.singular_vectors(omega, a.T @ (a @ omega))
    _, want, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(s[:8], want[:8], rtol=1e-3)
    assert np.linalg.svd(vt[:8] @ u[:, :8])[1].min() > 0.999


# 8 ---------------------------------------------------------------------------------------------------------------------


def _repeated_corpus():
    rng = random.Random(16)
    rows = [(i, prose(rng.randint(1, 300), rng)) for i in range(60)]
    shared = [prose(n, rng) for n in (49, 50, 51, 60, 120, 400)]
    for i in range(60, 110):
        w = prose(rng.randint(0, 80), rng)
        rows.append((i, f"{w} {rng.choice(shared)}. {prose(rng.randint(0, 80), rng)}"))
    rows += [
        (205, "same " * 290), (200, shared[5] + " " + shared[4]), (201, shared[4][: len(shared[4]) // 2] + "  --  " + shared[5]), (202, "same " * 300),
        (203, (prose(60, rng) + " ") * 3), (204, rows[70][1].upper()), (61, rows[61][1])
    ]
    return rows


def _unitigs(rows, k):
    """{(id, text): [(start, words, first document, spelled words)]}: runs of k-mers that several ids have, cut wherever a k-mer
    goes on, or comes from, in more than one way; the end of a text is a way of its own."""
    texts = {(i, t) for i, t in rows if i is not None and t}
    after, before, who = (collections.defaultdict(set) for _ in range(3))
    spelled = {}
    for i, t in texts:
        w = found(t)
        g = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
        spelled[i, t] = w, g
        for j, x in enumerate(g):
            who[x].add(i)
            after[x].add(g[j + 1] if j + 1 < len(g) else None)
            before[x].add(g[j - 1] if j else None)
    alone = lambda s: len(s) == 1 and None not in s
    out = {}
    for key, (w, g) in spelled.items():
        runs = []
        for j, x in enumerate(g):
            if len(who[x]) < 2:
                continue
            if runs and runs[-1][1] == j - 1 and alone(after[g[j - 1]]) and alone(before[x]):
                runs[-1][1] = j
            else:
                runs.append([j, j])
        out[key] = [(a, z - a + k, min(who[g[a]]), " ".join(w[a : z + k])) for a, z in runs]
    return out


def _same_spans(spark, rows, k, m):
    want = _unitigs(rows, k)
    d = docs(spark, rows)
    keys = {r.key: (r.doc_id, r.text) for r in d.select("doc_id", "text", F.struct("doc_id", substrings.row_key(F.col("text"))).alias("key")).collect()}
    spans = substrings.repeated_spans(d, k, m).collect()
    got, units = collections.defaultdict(list), {}
    for r in spans:
        i, t = keys[r.doc_id, r.text_key]
        words = " ".join(found(t)[r.start_word : r.start_word + r.n_words])
        got[i, t].append((r.start_word, r.n_words, r.first_doc_id, words))
        assert units.setdefault(r.path_id, words) == words
    assert len(set(units.values())) == len(units)
    assert {x: sorted(s) for x, s in got.items()} == {x: s for x, s in want.items() if s}
    return want


@pytest.mark.parametrize("seed", [1, 2])
def test_unitigs_of_a_branching_graph_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(40), " ".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))) for _ in range(60)]
    rows += [(50, "a " * 30), (51, "a " * 50), (52, "a b " * 20), (53, "b a " * 20), (50, "a " * 30), (54, "c " * 60), (54, "c " * 61)]
    _same_spans(spark, rows, 6, 3)


def test_repeated_spans_and_cuts_against_brute_force(spark):
    rows = _repeated_corpus()
    rng = random.Random(20)
    # ids with several texts: one has a copied passage, the other nothing of it
    rows += [(300, rows[5][1]), (5, prose(200, rng)), (301, prose(100, rng)), (302, prose(30, rng) + " " + rows[-1][1]), (302, prose(140, rng))]
    k = 50
    want = _same_spans(spark, rows, k, 24)
    gone = {x: {j for a, n, first, _ in s if first != x[0] for j in range(a, a + n)} for x, s in want.items()}
    d = docs(spark, rows + ODD)
    left = substrings.remove_repeats(d)
    assert left.columns == d.columns
    have = collections.defaultdict(list)
    for r in left.collect():
        have[r.doc_id].append(r)
        assert r.text is None or r.n_chars == len(r.text)
    by = collections.defaultdict(list)
    for i, t in rows:
        keep = [x for j, x in enumerate(found(t)) if j not in gone[i, t]]
        if keep or not found(t):
            by[i].append(keep)
    for i in {i for i, _ in rows}:
        assert sorted(found(r.text) for r in have[i]) == sorted(by[i])
    assert len(have[None]) == 1 and have[901][0].text is None and have[902][0].text == ""
    assert substrings.repeated_spans(d.limit(0)).count() == 0 and substrings.remove_repeats(d.limit(0)).count() == 0


def test_unequal_words_are_no_repeat(spark):
    d = spark.createDataFrame([(1, "a b c d"), (2, "x A b, c"), (3, "a b q")], "doc long, t string")
    key = {r.doc: r.k for r in d.select("doc", substrings.row_key(F.col("t")).alias("k")).collect()}
    units = spark.createDataFrame(
        [(1, key[1], 0, 3, 1, key[1], 0), (2, key[2], 1, 3, 1, key[1], 0), (3, key[3], 0, 3, 1, key[1], 0)],
        "doc long, row long, start long, words int, first long, first_row long, first_start long"
    )
    assert [tuple(r) for r in substrings._unequal(d, units).collect()] == [(3, key[3], 0)]


def test_long_paths_are_cut_the_same_way(spark, monkeypatch):
    monkeypatch.setattr(substrings, "LONGEST", 8)
    w = T.words(pa.array(["same " * 300, prose(200)]))
    at, count, doc, _, loop = substrings.paths(w)
    assert loop[doc == 0].all() and not loop[doc == 1].any()
    assert count.max() <= 8 and count.sum() == 251 + 151
    place = sorted(j for a, c in zip(at, count) for j in range(a, a + c))
    assert place == [*range(251), *range(300, 451)]


# 9 ---------------------------------------------------------------------------------------------------------------------


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(17)
    rows = [(i, prose(rng.choice([3, 40, 90, 200, 450, 700]), rng)) for i in range(300)]
    d = docs(spark, rows + ODD[:5] + [(906, "word " * 6000), (1, rows[1][1])])
    out = packing.pack(d, capacity=512, block=128).collect()
    words = collections.Counter()
    for i, t in rows + ODD[1:5] + [(906, "word " * 6000), (1, rows[1][1])]:
        words[i] += len(found(t))
    got, bins, claimed = collections.Counter(), collections.Counter(), {}
    pieces = collections.defaultdict(list)
    for r in out:
        got[r.doc_id] += r.n_words
        pieces[r.doc_id].append(r.piece)
        bins[r.bin] += r.n_words
        claimed[r.bin] = r.bin_words
    assert got == words and all(bins[b] == claimed[b] <= 512 for b in bins if b != "empty")
    assert all(sorted(p) == list(range(len(p))) for p in pieces.values())
    need = math.ceil(sum(words.values()) / 512)
    assert len(bins) - ("empty" in bins) <= 1.06 * need + 3
    assert packing.pack(d.limit(0)).count() == 0


def _fewest(size, capacity):
    best = [len(size)]
    size = sorted(size, reverse=True)

    def place(i, room):
        if len(room) >= best[0]:
            return
        if i == len(size):
            best[0] = len(room)
            return
        for r in set(room):
            if r >= size[i]:
                rest = list(room)
                rest[rest.index(r)] -= size[i]
                place(i + 1, rest)
        place(i + 1, [*room, capacity - size[i]])

    place(0, [])
    return best[0]


def test_packing_of_small_sets_is_optimal():
    rng = random.Random(70)
    hits = 0
    for n in range(60):
        size = [rng.randint(3, 14) for _ in range(rng.randint(1, 11))]
        best = _fewest(size, 20)
        assert -(-sum(size) // 20) <= packing.lower_bound(size, 20) <= best
        got = len(packing.evolve(size, 20, n)[0])
        assert got >= best
        hits += got == best
    assert hits >= 57


def test_evolution_saves_bins_where_best_fit_does_not():
    """Triplets that fill their bins exactly: best fit alone is far off. Without generations nothing is gained."""
    rng = random.Random(71)
    size = []
    for _ in range(120):
        a = rng.randint(380, 490)
        b = rng.randint(250, (1000 - a) // 2)
        size += [a, b, 1000 - a - b]
    bins, room = [], []
    packing.best_fit(list(range(len(size))), size, bins, room, 1000)
    best, left = packing.evolve(size, 1000, 1)
    assert packing.lower_bound(size, 1000) == 120 <= len(best) <= len(bins) - 8
    assert len(packing.evolve(size, 1000, 1, generations=0)[0]) > len(best)
    assert sorted(x for g in best for x in g) == list(range(360)) and min(left) >= 0


def test_packing_of_documents_by_evolution(spark):
    rng = random.Random(72)
    rows = []
    for _ in range(60):
        a = rng.randint(38, 49)
        b = rng.randint(25, (100 - a) // 2)
        rows += [(len(rows), prose(a, rng)), (len(rows) + 1, prose(b, rng)), (len(rows) + 2, prose(100 - a - b, rng))]
    out = packing.pack(docs(spark, rows), capacity=100, block=200)
    bins, room = [], []
    packing.best_fit(list(range(180)), [len(found(t)) for _, t in rows], bins, room, 100)
    assert out.select("bin").distinct().count() < len(bins)


def test_evolution_is_no_worse_than_best_fit():
    rng = random.Random(18)
    size = [rng.randint(20, 70) for _ in range(200)]
    bins, room = [], []
    packing.best_fit(list(range(200)), size, bins, room, 100)
    best, left = packing.evolve(size, 100, seed=1)
    assert sorted(x for b in best for x in b) == list(range(200)) and min(left) >= 0
    assert (len(best), -packing.fitness(left, 100)) <= (len(bins), -packing.fitness(room, 100))
    child, left = packing.crossover(best, bins, size, 100, np.random.default_rng(2))
    assert sorted(x for b in child for x in b) == list(range(200)) and all(100 - sum(size[x] for x in b) == r for b, r in zip(child, left))


# pipeline --------------------------------------------------------------------------------------------------------------


def test_pipeline_stages_on_odd_and_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(19)
    rows, labels = [], []
    for i in range(150):
        t = ". ".join(prose(9, rng).capitalize() for _ in range(8))
        rows.append((i, t.upper().replace(" ", "!! ") if i % 5 == 0 else t))
        labels.append((i, int(i % 5 > 0), 0))
    sentences = lambda n: ". ".join(prose(9, rng).capitalize() for _ in range(n)) + "."
    item, passage = sentences(5), sentences(9)
    copy = rows[7][1]
    rows += [
        (500, copy), (501, rows[8][1] + " " + item), (502, sentences(8) + passage), (503, sentences(7) + " " + passage), (504, None), (505, ""),
        (None, rows[11][1]), (12, rows[12][1])
    ]
    columns = [*CLASH, "doc", "cuts", "new", "gone", "again", "place", "_doc", "keep", "host"]
    d = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOC).withColumns({c: F.lit("x") for c in columns})
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = d.columns
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == names, name
        at.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        at = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        seen.append({r.doc_id: r.text for r in at.collect()})
    good, unique, cut, clean = seen
    assert 5 not in good and 6 in good and 500 in good
    assert 500 not in unique and 7 in unique and 8 in unique
    assert passage in cut[502]
    assert passage not in cut[503] and len(found(cut[503])) == 63
    assert 8 not in clean or item not in (clean[8] or "")
    assert 501 not in clean and 6 in clean and None in clean
    packed = pipeline.STAGES[-1][1](spark, at, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {i for i in clean if i is not None}
    empty = at.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_near_duplicate_stage_does_not_square_a_cluster(spark, tmp_path, monkeypatch):
    """200 near copies of one text, in pairs that are closer: the stage keeps one and forms few pairs of what has not met."""
    import corpus_pipeline

    rng = random.Random(91)
    base = prose(120, rng)
    twin = [_near(base, 0.04, rng) for _ in range(100)]
    rows = [(2 * i + k, t if k == 0 else t + " end" + str(i), "en", "x", 0) for i, t in enumerate(twin) for k in (0, 1)] + [(900, prose(120, rng), "en", "x", 0)]
    formed, of = [], grouping.cross_pairs

    def cross(*given):
        out = of(*given)
        formed.append(out.count())
        return out

    monkeypatch.setattr(grouping, "cross_pairs", cross)
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOC), str(tmp_path))
    assert {r.doc_id for r in got.collect()} == {0, 900}
    assert formed and sum(formed) < 10 * len(rows)


def test_near_duplicate_stage_verifies_no_pair_of_a_common_line(spark, tmp_path, monkeypatch):
    """300 unlike short texts with one line in common, and near copies among them: pairs of the line alone neither leave the tasks
    that form them nor are verified, and the groups are those of all true pairs, with small blocks and split buckets too."""
    import corpus_pipeline

    rng = random.Random(17)
    line = prose(16, rng)
    texts = [prose(rng.randint(9, 13), rng) + "\n" + line for _ in range(300)]
    texts += [_near(x, 0.06, rng) for x in texts[:40]]
    sets = [frozenset(zip(*[found(t)[k:] for k in range(3)])) for t in texts]
    want = _least([(a, b) for b, t in enumerate(sets) for a, s in enumerate(sets[:b]) if len(s & t) / len(s | t) >= minhash.THRESHOLD])
    formed, of = [], grouping.cross_pairs

    def cross(*given):
        out = of(*given)
        formed.append(out.count())
        return out

    monkeypatch.setattr(grouping, "cross_pairs", cross)
    for block, wide in ((1 << 12, 1 << 14), (50, 40)):
        monkeypatch.setattr(grouping, "BLOCK", block)
        monkeypatch.setattr(grouping, "WIDE", wide)
        formed.clear()
        kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([(i, t, "en", "x", 0) for i, t in enumerate(texts)], DOC), str(tmp_path))
        gone = set(range(len(texts))) - {r.doc_id for r in kept.collect()}
        assert gone <= set(want) and len(gone) >= 0.95 * len(want)
        assert max(formed) < len(texts)



def test_pipeline_stages_keep_other_texts_of_an_id(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(60)
    a, b, c, shared = prose(120, rng), prose(120, rng), prose(200, rng), prose(60, rng)
    item = prose(30, rng)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(pipeline.STAGES)
    left = lambda name, rows: sorted((r.doc_id, r.text) for r in stage[name](spark, docs(spark, rows), str(tmp_path)).collect())
    rows = [(1, a), (1, b), (2, c)]
    assert left("MinHash near-dedup", rows) == sorted(rows)
    assert left("MinHash near-dedup", [*rows, (1, b), (0, b), (1, a)]) == sorted([(0, b), (1, a), (2, c)])
    rows = [(1, f"{shared} {a}"), (2, f"{shared} {b}"), (2, c)]
    assert left("substring dedup", rows) == sorted([rows[0], (2, b), rows[2]])
    rows = [(1, f"{a} {item} {a}"), (1, b), (2, c)]
    assert left("benchmark decontamination", rows) == sorted(rows[1:])
