"""Each corpus operator against plain Python, and on awkward tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mirrorseq.llm import fingerprint, html, html_pages, mixing, packing, paragraphs, pii, quality, queries, sharding, simhash, similar, toxicity
from mirrorseq.llm.common import as_key, n_words, read
from mirrorseq.llm.components import components

from .conftest import ROWS


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_sharding_moves_only_into_the_new_shard(docs):
    rows = sharding.rendezvous(docs, as_key(F.col("doc_id")), [1.0] * 40, grown="grown").select("doc_id", "shard", "grown").collect()
    assert all(r.grown in (r.shard, 40) for r in rows) and any(r.grown == 40 for r in rows)
    assert len({r.shard for r in rows}) > 30


def test_sharding_follows_weights(spark):
    rows = sharding.rendezvous(spark.range(20000), as_key(F.col("id")), [1.0, 3.0]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 20000 for r in rows}
    assert abs(share[1] - 0.75) < 0.02


def test_sharding_awkward(awkward, empty):
    out = sharding.numbered(sharding.rendezvous(awkward, as_key(F.col("doc_id")), [1.0] * 3), "doc_id", ["text"]).collect()
    assert len(out) == len(ROWS)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.numbered(sharding.rendezvous(empty, as_key(F.col("doc_id")), [1.0]), "doc_id", ["text"]).count() == 0


def test_mixing_meets_targets(docs):
    rows = mixing.mix(docs, "doc_id", n_words(F.col("text"))).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert r.taken <= 3 * r.size
    total = sum(r.size for r in rows)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1
    for v in by.values():
        assert v[0].source_size == sum(r.size for r in v) and v[0].target <= 3 * v[0].source_size + 1e-6
        assert 0 <= v[0].target - sum(r.taken for r in v) <= max(r.size for r in v)


def test_mixing_caps_and_reshares(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(mixing.cycling_weights(rows)).collect()}
    assert got["a"] == 30 and got[None] == 15
    assert got["b"] == pytest.approx(1970 * 2 / 5) and got["c"] == pytest.approx(1970 * 3 / 5)


def test_mixing_nested(docs):
    few, many = ({r.doc_id for r in mixing.mix(docs, "doc_id", n_words(F.col("text")), budget=b).filter("copies > 0").collect()} for b in (0.1, 0.4))
    assert few < many


def test_mixing_awkward(awkward, empty):
    out = mixing.mix(awkward, "doc_id", n_words(F.col("text"))).collect()
    assert len(out) == len(ROWS)
    taken = mixing.take(awkward, "doc_id", n_words(F.col("text")))
    assert taken.columns == awkward.columns and taken.count() == sum(r.copies for r in out)
    assert mixing.mix(empty, "doc_id", n_words(F.col("text"))).count() == 0 == mixing.take(empty, "doc_id", n_words(F.col("text"))).count()


@pytest.fixture(scope="module")
def html_model(spark):
    return html.train(spark.createDataFrame([(p,) for p in html_pages.labelled_pages()], "html string"))


def test_html_on_held_out_layouts(html_model):
    """Pages of the same rule under another seed, by share of characters."""
    wrong = whole = 0
    for source in html_pages.labelled_pages(200, seed=2):
        page = html.Page(source)
        kept, labels = html.marginals(page, html_model), page.labels()
        for n, _, t, _ in page.runs:
            whole += len(t.strip())
            wrong += len(t.strip()) * ((kept[n] >= 0.5) != bool(labels[n]))
    assert wrong < 0.03 * whole


MAIN = "<p>The first paragraph of the story is here, with words.</p><p>The second one goes on for a while.</p>"


@pytest.mark.parametrize(
    "frame",
    ["<div>{}</div>", "<section>{}</section>", '<div class="lead-in">{}</div>', '<article class="post related-free">{}</article>', '<div id="x7"><div>{}</div></div>', "<table><tr><td>{}</td></tr></table>", "{}", '<main class="no-sidebar">{}</main>', '<div class="story"><svg class="i" />{}</div>'],
)
def test_html_frames_without_telling_names(html_model, frame):
    page = f'<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li></ul></nav>{frame.format(MAIN)}<aside><h3>Related</h3><a href="/q">More of it</a></aside><footer>(c) me</footer></body></html>'
    assert html.main_text(page, html_model) == "The first paragraph of the story is here, with words.\nThe second one goes on for a while."


def test_html_awkward_tables(spark, html_model):
    long = "<article><p>" + " " * 300_000 + "<b>x</b>" * 2000 + "</p></article>"
    rows = [(1, None, "u", "old"), (2, "", None, None), (3, f"<article>{MAIN}</article>", "u", "old"), (3, f"<article>{MAIN}</article>", "u", "old"), (None, long, "u", "old"), (4, "<div" + " a" * 100_000, "u", "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    out = html.extract(df, html_model)
    got = out.collect()
    assert out.columns == df.columns and len(got) == len(rows)
    assert [r.text for r in got if r.page_id in (1, 2)] == ["", ""] and len({r.text for r in got if r.page_id == 3}) == 1
    assert next(r.text for r in got if r.page_id is None) == "x" * 2000
    assert html.extract(df.limit(0), html_model).count() == 0


def test_html_marginals_are_exact(html_model):
    import itertools
    import math

    page = html.Page('<body><nav><ul><li>a</li></ul></nav><article><p>some text here</p><div class="ad">x</div></article></body>')
    n = len(page.tag)
    total, content = 0.0, [0.0] * n
    for ys in itertools.product((0, 1), repeat=n - 1):
        y = (0, *ys)
        p = math.exp(sum(html_model.get(f, (0.0, 0.0))[y[i]] for i, e in enumerate(page.evidence()) for f in e if i) + sum(html_model[f"parent {y[page.parent[i]]}"][y[i]] for i in range(1, n)))
        total += p
        content = [c + p * v for c, v in zip(content, y, strict=True)]
    assert html.marginals(page, html_model)[1:] == pytest.approx([c / total for c in content][1:])


def test_html_held_out_layout(html_model):
    page = (
        '<html><body><div class="top-nav"><ul><li><a href="/">x</a></li></ul></div><main><article class="post"><h1>A &amp; B</h1><p>First  para\n graph with <b>bold<br>text</b> inside it.<p>Second one &eacute; here and longer than that.'
        '<div class="advert"><p>Buy now</p></div></article></main><section id="comments"><div class="comment"><p>Nice article, I liked it a lot.</p></div></section><script>var a="<p>no</p>";</script><footer>c</footer>'
    )
    assert html.main_text(page, html_model) == "A & B\nFirst para graph with bold text inside it.\nSecond one é here and longer than that."


@pytest.mark.parametrize("source", [None, "", "<", "<p", "<!-- x", "plain", "<script>x", "</p></div>", '<a b="c', "<div>" * 500])
def test_html_awkward(html_model, source):
    assert isinstance(html.main_text(source, html_model), str)


@pytest.mark.parametrize("inner", ['<svg class="i" />', "<svg><svg/><svg><path/></svg><text>no</text></svg>", '<iframe src="x"/>', "<object><object>no</object>no</object>"])
def test_html_foreign_elements(inner):
    page = html.Page(f"<article><p>before</p>{inner}<p>between</p><svg><text>no</text></svg><p>after</p></article>")
    assert [t for _, _, t, _ in page.runs] == ["before", "between", "after"]


def test_html_on_pages(spark, sf, html_model):
    rows = html.extract(read(spark, sf, "pages"), html_model).collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        if inner:
            import html as std

            parts = [re.sub(r"\s+", " ", std.unescape(re.sub("<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner[1])]
            assert r.text == "\n".join(x for x in parts if x)


def test_packing_plan_is_tight_and_whole():
    rng = random.Random(1)
    counts = collections.Counter(min(1024, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(20000))
    rows = packing.plan(dict(counts))
    seen, bins = collections.Counter(), collections.defaultdict(list)
    for length, lo, hi, first, offset in rows:
        for r in range(lo, hi):
            seen[length, r] += 1
            bins[first + r - lo].append((offset, length))
    assert len(seen) == sum(counts.values()) and set(seen.values()) == {1}
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.02 * sum(n * c for n, c in counts.items()) / 1024


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    some = docs.select("doc_id", "text")
    packed = packing.pack(some, queries.TOKENIZER).cache()
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in some.collect()}
    bins = collections.defaultdict(list)
    for r in packed.collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length, part))
    assert sum(n for b in bins.values() for _, n, _ in b) == sum(map(len, ids.values()))
    whole = {r.sequence_id: r.ids for r in packing.sequences(some, packed, queries.TOKENIZER).collect()}
    for k, content in bins.items():
        assert whole[k] == [i for _, _, part in sorted(content, key=lambda c: c[0]) for i in part] and len(whole[k]) <= 1024


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|", " " * 10_000_000 + "b", "\n \t" * 400_000 + "x", "q" * 1_000_000, "Ünï 漢字 \U0001f600 1234567 don't   stop \r\n"])
def test_packing_ids_are_those_of_the_file(text):
    from tokenizers import Tokenizer

    assert packing.encoder(queries.TOKENIZER)(text) == Tokenizer.from_file(queries.TOKENIZER).encode(text, add_special_tokens=False).ids


def test_packing_awkward(awkward, empty):
    out = packing.pack(awkward, queries.TOKENIZER).collect()
    assert sum(r.start == 0 for r in out) == len(ROWS) and len({(r.sequence_id, r.offset) for r in out}) == len(out)
    assert packing.pack(empty, queries.TOKENIZER).count() == 0


def test_fingerprints_against_brute_force(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    errors, seen = [], {}
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[key].n_chars == len(text)
        assert seen.setdefault(text, got[key].fingerprint) == got[key].fingerprint
        a, b = collections.Counter(words(text)), collections.Counter(words(edited))
        most = sum((a | b).values())
        errors.append(got[key].near_edited - (sum((a & b).values()) / most if most else 1))
    assert abs(sum(errors) / len(errors)) < 0.03 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.07


def test_fingerprints_tell_the_threshold(spark):
    rows = []
    for k in range(60):
        common = [f"c{k}x{i}" for i in range(80)]
        rows.append((2 * k, [*common, *[f"a{k}x{i}" for i in range(10)]]))
        rows.append((2 * k + 1, [*common, *[f"b{k}x{i}" for i in range(10)]]))
    terms = spark.createDataFrame(rows, "id long, words array<string>").select("id", F.explode("words").alias("word"))
    found = fingerprint.signatures(terms.select("id", F.xxhash64("word").alias("term"), F.lit(1).alias("w")), ["id"], ["w"])
    got = {r.id: r.w for r in found.collect()}
    assert all(len(v) >= 64 for v in got.values())
    errors = [sum(x == y for x, y in zip(got[2 * k], got[2 * k + 1], strict=True)) / len(got[0]) - 0.8 for k in range(60)]
    assert (sum(e * e for e in errors) / 60) ** 0.5 < 0.065


def test_fingerprints_awkward(awkward, empty):
    out = fingerprint.fingerprints(awkward).collect()
    assert len(out) == len(ROWS)
    blank = [r.fingerprint for r in out if r.doc_id in (1, 2, 3)]
    assert len(set(blank)) == 1 and set(blank[0]) == {"-"}
    assert fingerprint.fingerprints(empty).count() == 0


def test_fingerprints_of_frequent_and_clustered_ids(spark):
    rows = [(None, f"null {i} a b c") for i in range(40)] + [(7, f"seven {i} words here") for i in range(300)] + [(10**15 + i, f"far text {i} x y z") for i in range(300)] + [(-3, "first one")]
    order = lambda r: (r.doc_id is not None, r.doc_id or 0)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint.fingerprints(df).collect()
    assert len(got) == len(rows)
    tied = {(r.doc_id, r.text): r.tie for r in df.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 1)).collect()}
    ordered = sorted(df.collect(), key=lambda r: (order(r), tied[r.doc_id, r.text]))
    expected = collections.Counter()
    for i, r in enumerate(ordered):
        following, half = ordered[(i + 1) % len(ordered)].text, len(r.text) // 2
        expected[r.doc_id, hashlib.sha256((r.text[: len(r.text) - half] + following[:half]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in got) == expected


@pytest.mark.parametrize("size", [2, 10, 1000])
def test_feistel_is_a_permutation(size):
    assert sorted(pii.permute(i, size, b"k", "t") for i in range(size)) == list(range(size))


def test_toxicity_held_out(spark):
    base = "/root/testdata/sf0.01"
    labels = read(spark, base, "labels")
    got = queries.op7_toxicity(spark, base).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    hits = sum(r.predicted for r in held if r.toxic)
    assert hits >= 0.6 * sum(r.toxic for r in held) and sum(r.predicted for r in held if not r.toxic) <= 0.05 * len(held)


def test_toxicity_grammar():
    grammar = toxicity.Grammar({})
    score = lambda t: max(grammar.clauses(t), default=0)
    assert score("You are an idiot.") > score("An idiot.") > score("not an idiot.") > 0
    assert score("He said idiot.") < score("Some idiot.") and score("I will kill you.") > score("to kill time") == 0
    assert score("I am not saying you are an idiot") < 0.5 * score("you are an idiot") == 0.5 * score("you are an \n idiot")
    assert score('not nice but you idiot') == score("you idiot") > score('"you idiot"') == score('He wrote. "yes. you idiot"')
    assert score("idiot, i mean it when i look at how all of it turned out for you") == score("you idiot")
    assert score("idiotic") == 0 == score("preidiot")


def test_toxicity_paths_against_all_paths():
    machines = [toxicity.threats(), toxicity.hostility(), toxicity.targets(), toxicity.negations(), toxicity.reports()]
    grammar, rng = toxicity.Grammar({}), random.Random(5)

    def paths(machine, symbols):
        found = [(machine.start, ())]
        for s, _ in symbols:
            found = [(to, (*factors, f)) for state, factors in found for to, f in machine.arcs[state, s]]
        return [factors for state, factors in found if state in machine.ends]

    for _ in range(200):
        symbols = [(s, rng.choice([1.0, 2.5]) if s in toxicity.HITS else 0.0) for s in rng.choices(toxicity.SYMBOLS, weights=[2, 2, 1, 2, 2, 1, 1, 1, 1, 4], k=rng.randint(0, 9))]
        best = max(sum(w * a * b * c * d * e for (_, w), a, b, c, d, e in zip(symbols, *choice, strict=True)) for choice in itertools.product(*(paths(m, symbols) for m in machines)))
        assert grammar.read(symbols) == pytest.approx(best)


def test_toxicity_query_against_plain_python(spark, sf):
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    grammar, weights = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, sf).collect()}
    for r in docs.collect():
        z = sum(w * x for w, x in zip(weights, (*grammar.features(r.text), 1.0), strict=True))
        assert got[r.doc_id].score == pytest.approx(1 / (1 + 2.718281828459045 ** -z)) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.7)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_toxicity_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(awkward, labels)
    assert len(toxicity.score(awkward, model, ["doc_id"]).filter("score between 0 and 1").collect()) == len(ROWS)
    assert toxicity.score(empty, model, ["doc_id"]).count() == 0


def test_masks_cover_the_radius():
    from itertools import combinations

    for radius in (1, 2):
        masks = simhash.masks(radius)
        for k in range(1, radius + 1):
            for c in combinations(range(64), k):
                assert any(not m & sum(1 << i for i in c) for m in masks)


@pytest.mark.parametrize("pairwise", [64, 2])
def test_near_pairs_against_brute_force(spark, pairwise):
    rng = random.Random(2)
    values = set()
    for _ in range(40):
        v = rng.getrandbits(64)
        for _ in range(6):
            values.add(v)
            v ^= 1 << rng.randrange(64)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.near_pairs(spark.createDataFrame([(v,) for v in signed], "fp long"), pairwise=pairwise)
    got = {r.node: r.root for r in components(edges).collect()}
    root = {v: v for v in signed}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {v: got.get(v, v) for v in signed} == {v: find(v) for v in signed}


def test_simhash_awkward(awkward, empty):
    out = simhash.near_components(awkward).collect()
    assert len(out) == len(ROWS)
    by = collections.defaultdict(set)
    for r in out:
        by[r.doc_id].add(r.component_id)
    assert by[1] == by[2] == by[3] == {1} and by[5] == by[6] == {5}
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "7", "8", "None"]
    assert simhash.near_components(empty).count() == 0 == simhash.keep_one(empty).count()


def _five(text):
    w = words(text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def _least_roots(sets, alike):
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        if find(a) != find(b) and alike(sets[a], sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in sets}


def test_keep_one_recall_against_brute_force(spark):
    rng = random.Random(8)
    fresh = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    rows = []
    for base in (fresh(rng.randint(60, 300)) for _ in range(60)):
        rows.append((len(rows), " ".join(base)))
        for edits in (1, len(base) // 60, len(base) // 40, len(base) // 20):
            copy = list(base)
            for at in rng.sample(range(len(base)), edits):
                copy[at] = fresh(1)[0]
            rows.append((len(rows), " ".join(copy)))
    roots = _least_roots({i: _five(t) for i, t in rows}, lambda a, b: _jaccard(a, b) >= 0.8)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(roots.values()) and 60 < len(kept) < 250


def test_keep_one_null_and_shared_ids(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2] + " x"), (1, texts[3]), (1, texts[4]), (2, texts[4]), (None, texts[5]), (3, texts[5])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((str(r.doc_id), r.text[0]) for r in kept)
    assert got == [("1", "d"), ("1", "e"), ("3", "f"), ("None", "a"), ("None", "b"), ("None", "c")]


@pytest.mark.parametrize("hot", ["unlike", "copies"])
def test_links_of_a_large_band_against_brute_force(spark, hot):
    rng = random.Random(9)
    fresh = lambda n: rng.sample(range(10**9), n)
    common = fresh(10)
    sets = {}
    for _ in range(100 if hot == "unlike" else 3):
        base = [*common, *fresh(30)]
        for _ in range(3 if hot == "unlike" else 100):
            sets[rng.randrange(10**12)] = set(base[:-2] + fresh(2))
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "h long, grams array<long>")
    members = similar.shared_bands(df.select(F.lit(5).cast("long").alias("key"), "h"))
    got = {r.node: r.root for r in components(similar.links(members, df)).collect()}
    expected = _least_roots(sets, lambda a, b: _jaccard(a, b) >= 0.8)
    assert {k: got.get(k, k) for k in sets} == expected and len(set(expected.values())) == (100 if hot == "unlike" else 3)


def test_simhash_fingerprint():
    import xxhash

    text = "A b C d e"
    grams = [b"a b c", b"b c d", b"c d e"]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    expected = sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > 3)
    assert simhash.simhash(text) & (2**64 - 1) == expected and simhash.simhash(" ") == 0


def test_paragraphs_find_embedded_passages(spark):
    rng = random.Random(3)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    passage = fresh(80)
    rows = [(i, f"{fresh(60)} {passage} {fresh(60)}" if i % 3 == 0 else fresh(150)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = paragraphs.repeated(df)
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == 30
    for i in range(30):
        assert (got[i].n_removed >= 40) == (i % 3 == 0 and i > 0), i
    left = {r.doc_id: r.text for r in paragraphs.remove(df, found).collect()}
    assert all(left[i] == t for i, t in rows if i % 3 or i == 0) and all(len(left[i].split()) == 200 - got[i].n_removed for i in range(3, 30, 3))


def test_paragraphs_link_near_copies(spark):
    """Passages with a changed word in different places still go."""
    rng = random.Random(4)
    fresh = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    passage, rows = fresh(200), []
    for i in range(20):
        copy = list(passage)
        copy[rng.randrange(200)] = "changed"
        rows.append((i, " ".join([*fresh(30), *copy, *fresh(30)])))
    got = {r.doc_id: r.n_removed for r in paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == 0 and all(n >= 140 for k, n in got.items() if k) and sum(got.values()) > 19 * 165


def test_paragraph_bands_are_tuned():
    assert paragraphs.n_bands(0.8, 0.95) == 2 and paragraphs.n_bands(0.8, 0.99, 2) == 5 and paragraphs.n_bands(0.5, 0.95) == 5


@pytest.mark.parametrize("variants", [300])
def test_paragraph_variants_are_one_class(spark, variants):
    """A paragraph and its one-word variants: links against all pairs."""
    rng = random.Random(14)
    fresh = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    base, texts = fresh(60), {}
    for k in range(variants):
        copy = list(base)
        copy[rng.randrange(60)] = fresh(1)[0]
        texts[k] = " ".join(copy)
    cuts = [(k, *paragraphs.split(t)[0].tolist()[2:], t) for k, t in texts.items()]
    whole = [(k, paragraphs._mixed(np.array([k], np.uint64), 1).view(np.int64)[0].item(), t) for k, *_, t in cuts]
    mins = {}
    for k, _, t in whole:
        grams = [xxhash.xxh64_intdigest(" ".join(g)) for g in sorted(_five(t))]
        mins[k] = [min((x * f) & (2**63 - 1) for x in grams) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    df = spark.createDataFrame([(h, *mins[k], t) for k, h, t in whole], "h long, m0 long, m1 long, words string")
    members = paragraphs.band_members(df)
    found = similar.links(members, df.select("h", F.transform(paragraphs._grams("words"), lambda g: F.xxhash64(g)).alias("grams")))
    got = {r.node: r.root for r in components(found).collect()}
    sets = {h: _five(t) for _, h, t in whole}
    expected = _least_roots(sets, lambda a, b: _jaccard(a, b) >= 0.8)
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if expected[a] == expected[b]]
    assert len(linked) > 1000 and sum(got.get(a, a) == got.get(b, b) for a, b in linked) >= 0.9 * len(linked)


def test_paragraphs_of_rows_with_one_id(spark):
    rng = random.Random(15)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    passage = fresh(80)
    rows = [(1, f"{fresh(20)} {passage}"), (2, f"{passage} {fresh(30)}"), (2, "two words"), (2, "two words"), (None, passage), (3, None), (3, f"{fresh(5)} {passage}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = paragraphs.repeated(df)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in found.collect())
    assert got == {(1, 100, 0): 1, (2, 110, 80): 1, (2, 2, 0): 2, (None, 80, 0): 1, (3, 0, 0): 1, (3, 85, 80): 1}
    left = collections.Counter((r.doc_id, len(words(r.text))) for r in paragraphs.remove(df, found).collect())
    assert left == {(1, 100): 1, (2, 30): 1, (2, 2): 2, (None, 80): 1, (3, 0): 1, (3, 5): 1}


def test_paragraphs_short_passages_against_brute_force(spark):
    rng = random.Random(12)
    fresh = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    rows = []
    for size in range(49, 61):
        for _ in range(5):
            passage = fresh(size)
            for part in (passage[5:45], passage, passage):  # the first holds too little of it
                rows.append((len(rows), [*fresh(rng.randint(0, 60)), *part, *fresh(rng.randint(0, 60))]))
    found = paragraphs.repeated(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    got = {r.doc_id: {x for s in r.spans or [] for x in range(s["at"], s["at"] + s["n"])} for r in found}
    seen, covered = set(), 0
    for i, w in rows:
        grams = [tuple(w[k : k + 51]) for k in range(len(w) - 50)]
        expected = {k + x for k, g in enumerate(grams) if g in seen for x in range(51)}
        assert expected <= got[i], i
        covered += len(expected)
        seen.update(grams)
    assert covered == 5 * sum(range(51, 61))


def test_paragraphs_of_a_large_band_against_brute_force(spark):
    rng = random.Random(11)
    fresh = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    common, texts = fresh(12), {}
    for _ in range(150):
        base = fresh(40)
        texts[len(texts)] = " ".join([*common, *base])
        texts[len(texts)] = " ".join([*common, *base[:-1], "other"])
    rows = [(h, 7, h, t) for h, t in texts.items()]
    df = spark.createDataFrame(rows, "h long, m0 long, m1 long, words string")
    members = paragraphs.band_members(df)
    assert members.count() == 300
    found = similar.links(members, df.select("h", F.transform(paragraphs._grams("words"), lambda g: F.xxhash64(g)).alias("grams")))
    got = {(r.a, r.b) for r in found.collect()}
    assert got == {(k, k + 1) for k in range(0, 300, 2)}
    sets = {k: _five(t) for k, t in texts.items()}
    assert got == {(a, b) for a, b in itertools.combinations(sets, 2) if _jaccard(sets[a], sets[b]) >= 0.8}


def test_paragraphs_awkward(awkward, empty):
    found = paragraphs.repeated(awkward)
    out = found.collect()
    assert len(out) == len(ROWS) and all(r.n_removed <= r.n_words for r in out) and all(r.n_removed == 0 for r in out if r.doc_id in (1, 2, 3, 5, 6, None))
    left = paragraphs.remove(awkward, found)
    assert left.columns == awkward.columns and left.count() == len(ROWS)
    assert paragraphs.repeated(empty).count() == 0 == paragraphs.remove(empty, paragraphs.repeated(empty)).count()


def test_quality_measures_against_brute_force(docs, awkward):
    for df in (docs, awkward):
        rows = df.select("doc_id", "text").collect()
        got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.measures(df.select("doc_id", "text")).collect())
        expected = collections.Counter()
        for r in rows:
            text, w = r.text or "", words(r.text)
            windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
            seen = collections.Counter(windows)
            covered = {i + k for i, g in enumerate(windows) if seen[g] > 1 for k in range(3)}
            lines = [x for x in text.split("\n") if words(x)]
            expected[r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)] += 1
        assert got == expected


def test_quality_agrees_with_labels(spark):
    base = "/root/testdata/sf0.01"
    rows = queries.op10_quality(spark, base).join(read(spark, base, "labels"), "doc_id").filter("not base_failed").collect()
    assert sum(r.kept for r in rows if r.quality) >= 0.98 * sum(r.quality for r in rows)
    assert sum(r.kept for r in rows if not r.quality) <= 0.02 * sum(not r.quality for r in rows)


def _simulated(right_good, right_bad, share, n, rng):
    """Vote patterns of independent voters, and how often each is good."""
    counts, good_counts = collections.Counter(), collections.Counter()
    for _ in range(n):
        good, code = rng.random() < share, 0
        for g, b in zip(right_good, right_bad, strict=True):
            votes = rng.random() < 0.7
            says_good = (rng.random() < g) if good else (rng.random() >= b)
            code = code * 3 + (quality.ABSTAIN if not votes else quality.GOOD if says_good else quality.BAD)
        counts[code] += 1
        good_counts[code] += good
    return counts, good_counts


def test_quality_em_finds_the_accuracies_of_simulated_voters():
    rng = random.Random(6)
    right_good, right_bad = [0.95, 0.9, 0.8, 0.7, 0.99, 0.6], [0.9, 0.7, 0.85, 0.6, 0.5, 0.55]
    counts, good = _simulated(right_good, right_bad, 0.7, 60000, rng)
    prior, weights = quality.fit(dict(counts), n_rules=6)
    assert prior == pytest.approx(math.log(0.7 / 0.3), abs=0.15)
    for j, (g, b) in enumerate(zip(right_good, right_bad, strict=True)):
        assert weights[j, quality.GOOD] == pytest.approx(math.log(g / (1 - b)), abs=0.25)
        assert weights[j, quality.BAD] == pytest.approx(math.log((1 - g) / b), abs=0.25)
    wrong = 0
    for code, n in counts.items():
        odds = prior + sum(weights[j, code // 3 ** (5 - j) % 3] for j in range(6))
        wrong += n - good[code] if odds >= 0 else good[code]
    assert wrong < 0.16 * 60000


def test_quality_raises_the_likelihood():
    rng = random.Random(7)
    counts, _ = _simulated([0.9, 0.8, 0.85], [0.8, 0.9, 0.7], 0.6, 5000, rng)

    def likelihood(model):
        total = 0.0
        for code, n in counts.items():
            votes = [code // 3 ** (2 - j) % 3 for j in range(3)]
            p = 1 / (1 + math.exp(-model[0]))
            both = [p, 1 - p]
            for j, v in enumerate(votes):
                if v:
                    # g / (1 - b) and (1 - g) / b give back g and b
                    up, down = math.exp(model[1][j, quality.GOOD]), math.exp(model[1][j, quality.BAD])
                    b = (1 - up) / (down - up)
                    g = up * (1 - b)
                    both = [both[0] * (g if v == quality.GOOD else 1 - g), both[1] * (1 - b if v == quality.GOOD else b)]
            total += n * math.log(sum(both))
        return total

    found = [likelihood(quality.fit(dict(counts), n_rules=3, steps=k)) for k in (1, 5, 30, 200)]
    assert found == sorted(found)


def test_quality_bad_votes_can_be_outvoted(docs):
    rows = quality.voted(quality.measures(docs.select("doc_id", "text"))).select("pattern", "base_failed")
    kept = quality.judged(rows).filter("kept").select("pattern").distinct().collect()
    assert any(quality.BAD in [r.pattern // 3**j % 3 for j in range(quality.N_RULES)] for r in kept)


def test_quality_query_against_plain_python(spark, sf):
    rows = quality.voted(quality.measures(read(spark, sf, "documents").select("doc_id", "text"))).collect()
    prior, weights = quality.fit(dict(collections.Counter(r.pattern for r in rows if not r.base_failed)))
    got = {r.doc_id: r for r in queries.op10_quality(spark, sf).collect()}
    for r in rows:
        odds = prior + sum(weights[j, r.pattern // 3 ** (quality.N_RULES - 1 - j) % 3] for j in range(quality.N_RULES))
        assert got[r.doc_id].posterior == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-6)
        assert got[r.doc_id].base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert got[r.doc_id].kept == (not r.base_failed and odds >= 0)


def test_quality_awkward(awkward, empty):
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} <= {None, 4, 7}
    assert quality.keep_good(empty).count() == 0


@pytest.mark.parametrize("hot", [100_000, 3])
def test_components_of_long_chains(spark, hot):
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(3000, 3040).select(F.lit(2999).cast("long").alias("a"), F.col("id").alias("b"))
    edges = chain.unionByName(star).unionByName(spark.createDataFrame([(1000, 1000), (2001, 2000)], "a long, b long"))
    got = {r.node: r.root for r in components(edges, hot=hot).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 2999 for i in range(2999, 3040)) and got[2001] == got[2000] == 2000 and 1000 not in got


def test_simhash_query_against_brute_force(spark, tmp_path):
    rng = random.Random(16)
    rows = [(None, None), (1000, ""), (900, " \t"), (901, "one two")]
    for _ in range(25):
        base = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(400)]
        for _ in range(4):
            copy = list(base)
            for at in rng.sample(range(400), rng.choice([0, 1, 1, 2, 4])):
                copy[at] = copy[at].upper() if rng.random() < 0.3 else "other"
            rows.append((rng.randrange(10**6), " ".join(copy)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def print_of(text):
        w = [x.lower() for x in words(text)]
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes)) if hashes else 0

    prints = [print_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), k) if x is not None), default=None)
    expected = collections.Counter((k, f"{prints[i]:016x}", least[find(i)]) for i, (k, _) in enumerate(rows))
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, str(tmp_path)).collect())
    assert got == expected and len({v for v in least.values()}) < len(rows)


def test_pipeline_stages_against_plain_python(spark, sf):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = read(spark, sf, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}

    kept = stages["quality_rules"](spark, docs, sf)
    assert kept.columns == columns
    good = {r.doc_id for r in queries.op10_quality(spark, sf).filter("kept").collect()}
    assert {r.doc_id: r for r in kept.collect()} == {k: rows[k] for k in good}

    kept = stages["near_duplicates"](spark, docs, sf)
    assert kept.columns == columns
    roots = _least_roots({k: _five(r.text or "") for k, r in rows.items()}, lambda a, b: a == b or bool(a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and _jaccard(a, b) >= 0.8))
    assert {r.doc_id: r for r in kept.collect()} == {k: rows[k] for k in roots.values()}

    safe = stages["personal_data"](spark, docs, sf)
    assert safe.columns == columns
    key = pii.session_key(spark)
    for r in safe.collect():
        text = pii.pseudonymise(rows[r.doc_id].text, key)[0]
        assert r == type(r)(**{**rows[r.doc_id].asDict(), "text": text, "n_chars": None if text is None else len(text)})

    mixed = stages["source_mix"](spark, docs, sf)
    assert mixed.columns == columns
    sizes, places = {}, collections.defaultdict(list)
    for k, r in rows.items():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
        places[r.source].append((int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16), k))
    order = sorted(sizes, key=lambda x: (x is None, x))
    weight = {x: 1 + i % 3 for i, x in enumerate(order)}
    left, target = sum(sizes.values()), {}
    while len(target) < len(order):  # those over their cap stop, the rest is dealt again
        open_ = [x for x in order if x not in target]
        level = left / sum(weight[x] for x in open_)
        full = [x for x in open_ if 3 * sizes[x] <= level * weight[x]]
        for x in full or open_:
            target[x] = 3 * sizes[x] if full else level * weight[x]
        left -= sum(target[x] for x in full)
    expected = collections.Counter()
    for x in order:
        whole = int(target[x] // sizes[x]) if sizes[x] else 0
        quota, running = target[x] - whole * sizes[x], 0
        for _, k in sorted(places[x]):
            running += len(words(rows[k].text))
            expected[k] += whole + (running <= quota)
    assert collections.Counter(r.doc_id for r in mixed.collect()) == +expected


def test_pipeline(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf).collect()
    assert out
    at = collections.defaultdict(int)
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 1024


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_awkward(spark, sf, awkward, empty, stage):
    import corpus_pipeline

    for df in (awkward, empty):
        out = corpus_pipeline.STAGES[stage][1](spark, df, sf)
        out.collect()


@pytest.mark.parametrize("hot", [1, 4, 100_000])
def test_keys_of_many_rows_join_like_all_others(spark, hot):
    rows = [(i, 7 if i % 2 else i % 5) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, w long")
    facts = paragraphs._shared(df)
    least = {w: min(i for i, v in rows if v == w) for _, w in rows}
    got = paragraphs._with_facts(df, facts, "w", hot).select("id", "w", "keeper").collect()
    assert sorted(map(tuple, got)) == sorted((i, w, least[w]) for i, w in rows)
    assert not paragraphs._with_facts(df, facts.limit(0), "w", hot).count()
