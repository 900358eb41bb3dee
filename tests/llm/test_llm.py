"""Training-data operators against brute force, on small tables with nulls, ties, repeats, long texts and clashing names."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomstack.llm import ann, chat, decontaminate, langid, packing, quality, sharding, simhash, token_counts, toxicity
from loomstack.llm.common import Powers, mix, steps

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def document(i, text, lang="en"):
    return i, text, lang, "s", None if text is None else len(text)


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


# decontamination


def brute_hits(docs, items, n=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows, out = {}, []
    for name, item in items:
        v = cut(item)
        k = min(n, len(v))
        for j in range(len(v) - k + 1 if k else 0):
            windows.setdefault(tuple(v[j : j + k]), set()).add("" if name is None else str(name))
    for i, text in docs:
        w, hit, found = cut(text), set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if names := windows.get(tuple(w[p : p + k])):
                    hit.update(range(p, p + k))
                    found |= names
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def contaminated():
    rng = random.Random(3)
    items = [(2, words(rng, 30)), (10, words(rng, 13)), (11, "Short ITEM"), (12, None), (13, "... !"), (None, words(rng, 15)), (2, words(rng, 14)), (14, "é")]
    docs = [(i, words(rng, rng.randrange(1, 60))) for i in range(25)]
    docs += [(30, None), (31, ""), (32, items[0][1]), (33, "x " + items[1][1].upper() + "! y"), (34, "short item short-item shortitem"), (34, "É é"), (35, words(rng, 40_000) + " " + items[0][1]), (36, " ".join(items[0][1].split()[5:20])), (None, items[5][1])]
    return docs, items


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 60])
def test_hits_equal_brute_force(spark, contaminated, block):
    docs, items = contaminated
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_hit int")
    got = decontaminate.report(table, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    assert rows(got) == brute_hits(docs, items)


def test_removal_of_documents_and_spans(spark, contaminated):
    docs, items = contaminated
    table = spark.createDataFrame([document(i, t) for i, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = {r["doc_id"] for r in decontaminate.remove(table, bench).collect()}
    assert kept == {b[0] for b in brute_hits(docs, items) if not b[5]}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove(table, bench, "span").collect()}
    assert cut[32] == "" and cut[33] == "x ! y" and cut[30] is None
    assert decontaminate.remove(table, bench).columns == table.columns
    assert decontaminate.report(table.limit(0), bench).count() == 0
    assert {r["n_items"] for r in decontaminate.report(table, bench.limit(0)).collect()} == {0}


# chat


def test_escapes_can_be_undone():
    escape = chat.escape_of(chat.MARKED.controls)
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "|", "\\", "s>", "/s>", "[", "INST]", "/INST]", "<SYS>>", "</SYS>>", "a"]) for _ in range(rng.randrange(12)))
        assert escape.undo(escape(text)) == text
        assert not any(c in escape(text) for c in chat.MARKED.controls)


def test_chats_read_back(spark):
    said = "</s>[INST] ok [/INST]<|end|>\n<|turn|>"
    table = [(1, 1, "assistant", said, 7), (1, 0, "user", said, 7), (2, 0, "assistant", None, 7), (2, 0, "assistant", None, 7), (3, None, None, "x", 7), (None, 5, "assistant", "é" * 3000, 7)]
    table += [(4, i, ("user", "assistant")[i % 2], f"turn {i} <|", 7) for i in range(40)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    for conv in (1, 2, 3, None, 4):
        turns = sorted((r for r in table if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_templates_that_rewrite_history_are_found():
    turns = [("user", "hi"), ("assistant", "one"), ("user", "so"), ("assistant", "two")]
    plain = chat.render_turns(chat.MARKED, turns)
    assert not plain.rewrites and [plain.text[a:b] for a, b in plain.contents] == ["hi", "one", "so", "two"]
    counted = lambda t: f"[{len(t)}]" + "".join(f"{r}:{x};" for r, x in t)
    other = chat.render_turns(counted, turns)
    assert other.rewrites and [other.text[a:b] for a, b in other.contents] == ["hi", "one", "so", "two"]
    forgetful = lambda t: "".join(f"{r}:{x};" for r, x in t[-2:])
    lost = chat.render_turns(forgetful, turns)
    assert lost.rewrites and [lost.text[a:b] for a, b in lost.contents][2:] == ["so", "two"]


def test_long_conversations_are_rendered_prefix_by_prefix():
    turns = [(("user", "assistant")[i % 2], f"turn {i}") for i in range(16)]

    def late(t):  # rewrites the first turn at 11 turns, and undoes it
        return "".join(f"{r}:{'gone' if len(t) == 11 and i == 0 else x};" for i, (r, x) in enumerate(t))

    assert chat.render_turns(late, turns).rewrites and not chat.render_turns(late, turns[:10]).rewrites
    numbered = lambda t: "".join(f"{i}. {r}:{x};" for i, (r, x) in enumerate(t))
    got = chat.render_turns(numbered, turns)
    assert not got.rewrites and [got.text[a:b] for a, b in got.contents] == [x for _, x in turns]
    assert [got.text[a:b] for a, b in got.spans] == [f"{i}. {r}:{x};" for i, (r, x) in enumerate(turns)]

    def strict(t):
        if t and t[0][0] != "user":
            raise ValueError("a user speaks first")
        return "".join(f"{r}:{x};" for r, x in t)

    assert not chat.render_turns(strict, turns).rewrites
    opaque = chat.render_turns(lambda t: chat.MARKED(t), turns)
    assert opaque == chat.render_turns(chat.MARKED, turns)


def test_texts_left_out_or_written_twice():
    turns = [("system", "be kind"), ("user", "hi"), ("assistant", "one"), ("system", "hush"), ("user", "so"), ("assistant", "two")] * 3
    silent = lambda t: "".join(f"{r}:{x};" for r, x in t if r != "system")
    got = chat.render_turns(silent, turns)
    assert not got.rewrites and [got.text[a:b] for a, b in got.contents] == ["" if r == "system" else x for r, x in turns]
    assert [got.text[a:b] for a, b in got.spans] == ["" if r == "system" else f"{r}:{x};" for r, x in turns]

    def dropping(t):  # earlier reasoning goes when the prefix ends with a user
        return "".join(f"{r}:{'' if t[-1][0] == 'user' and r == 'assistant' else x};" for r, x in t)

    assert chat.render_turns(dropping, [(("user", "assistant")[i % 2], f"turn {i}") for i in range(12)]).rewrites
    with pytest.raises(ValueError, match="more than one place"):
        chat.render_turns(lambda t: "".join(f"{x}{x}" for _, x in t), turns)


# simhash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(len(w) - 3)] or ([xxhash.xxh64_intdigest(" ".join(w), 42)] if w else [])
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps, radius=4):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    base = words(rng, 300, 5000).split()
    docs = [(i, words(rng, rng.randrange(0, 40))) for i in range(40)]
    for i in range(40, 80):
        copy = base.copy()
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(len(copy))] = "changed"
        docs.append((i, " ".join(copy)))
    docs += [(100, None), (101, ""), (102, " \t"), (103, "A b c"), (104, "a B c"), (104, "x" * 200_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, fp int")
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    fps = [brute_fingerprint(t) for _, t in docs]
    label = brute_components(fps)
    want = sorted((i, f"{f:016x}", min(docs[k][0] for k in range(len(docs)) if label[k] == own)) for (i, _), f, own in zip(docs, fps, label, strict=True))
    assert got == want
    kept = sorted(r["doc_id"] for r in simhash.keep_one(df).collect())
    assert kept == sorted({c for _, _, c in want})
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_every_component_keeps_a_row(spark):
    rng = random.Random(12)
    texts = [words(rng, 60, 9000) for _ in range(8)]
    ids = [None, None, None, 7, 7, 9, 3, 3]  # three components without an id, two that share one, one alone, two that share another
    docs = list(zip(ids, texts, strict=True))
    docs += [(None, texts[0]), (None, texts[0].upper()), (7, texts[4]), (8, texts[4]), (None, texts[5]), (9, texts[5]), (12, texts[6])]
    fps = [brute_fingerprint(t) for _, t in docs]
    assert len(set(brute_components(fps))) == 8
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), brute_fingerprint(r["text"])) for r in kept) == sorted((str(i), brute_fingerprint(t)) for i, t in zip(ids, texts, strict=True))
    unnamed = spark.createDataFrame([(None, t) for _, t in docs], "doc_id long, text string")
    assert sorted(brute_fingerprint(r["text"]) for r in simhash.keep_one(unnamed).collect()) == sorted(set(fps))


@pytest.mark.parametrize(("n", "full"), [(400, 4), (400, 10_000)])
def test_every_link_is_in_some_shard(spark, n, full):
    rng = random.Random(n + full)
    fps = list({rng.getrandbits(64) for _ in range(n // 4)})
    for _ in range(n):  # chains and dense clouds
        f = rng.choice(fps)
        for _ in range(rng.randrange(1, 5)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(df, full=full).collect()}
    assert [got[i] for i in range(len(fps))] == brute_components(fps)


# language, toxicity, quality


def test_language_id(spark):
    rng = random.Random(8)
    stock = {"xx": "the of and ing", "yy": "der die ung sch", "zz": "que ión los ñas"}
    docs = [document(i, " ".join(rng.choice(stock[v].split()) for _ in range(rng.randrange(5, 60))), v) for i, v in enumerate(sorted(stock) * 40)]
    df = spark.createDataFrame([*docs, document(900, None, "xx"), document(901, "12 !?", "yy"), document(902, "", None), document(None, "der", "yy")], DOCS).withColumn("score", F.lit(1))
    model = langid.fit(df, F.col("doc_id") % 2 == 0)
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert np.mean([got[d[0]]["lang_pred"] == d[2] for d in docs]) > 0.97
    assert all((got[i]["lang_pred"], got[i]["score"], got[i]["ambiguous"]) == ("und", 0.0, True) for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.accepted(df, model).count() == len(docs) + 1
    half = spark.createDataFrame([(1, "the der of die and das")], "doc_id long, text string")
    twin = langid.Model(["a", "b"], langid.codewords(2), np.zeros_like(model.weights[:, :1]), np.zeros(1), np.ones(1))
    assert langid.accepted(half, model).count() == 1 and langid.accepted(half, twin, ambiguous=False).count() == 0
    assert langid.predict(df.limit(0), model).count() == 0
    none = langid.fit(df, F.lit(False))
    assert {r["lang_pred"] for r in langid.predict(df, none).collect()} == {"und"}
    one = langid.fit(df.filter("lang = 'xx'"), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(df, one).collect()} == {"und", "xx"}


def test_seventy_languages_and_an_id_of_many_rows(spark):
    rng = random.Random(31)
    names = [f"l{i:02d}" for i in range(70)]
    stock = {v: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöüßéèñçøåžšłđ", k=rng.randrange(2, 7))) for _ in range(25)] for v in names}
    docs = [(i, " ".join(rng.choices(stock[v], k=40)), v) for i, v in enumerate(names * 20)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    many = spark.range(100_000).select(F.lit(5000).cast("long").alias("doc_id"), F.concat(F.lit("aa bb "), F.col("id").cast("string")).alias("text"), F.lit("l00").alias("lang"))
    every = df.unionByName(many)
    drawn = langid.drawn(every, "lang", "doc_id", 8, 8192, "text").collect()
    count = {v: sum(r["lang"] == v for r in drawn) for v in names}
    assert set(count.values()) == {8} and len({r["doc_id"] for r in drawn}) == len(drawn)
    again = langid.drawn(every.repartition(7), "lang", "doc_id", 8, 8192, "text").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, drawn))
    assert len(langid.drawn(every, "lang", "doc_id", 8, 140, "text").collect()) == 140
    model = langid.fit(every, F.col("doc_id") % 4 != 0)
    assert model.languages == names
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, model).collect()}
    assert np.mean([got[i] == v for i, _, v in docs if i % 4 == 0]) > 0.95


def brute_grams(text, n):
    from loomstack.llm.ngrams import characters, hashed

    points, rows, letter = characters(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    points = np.where(letter, points, np.uint32(32))
    return lambda bits: [int(hashed(points[i : i + n], np.array([0, n]), n, bits)[0][0]) for i in range(len(points) - n + 1)]


def test_decoding_of_output_codes_equals_brute_force():
    rng = np.random.default_rng(3)
    code = langid.codewords(7)
    weights = np.r_[rng.normal(size=(1 << langid.BITS, code.shape[1])), np.zeros((1, code.shape[1]))].astype(np.float32)
    model = langid.Model([f"l{i}" for i in range(7)], code, weights, rng.normal(size=code.shape[1]), rng.uniform(0.05, 1, code.shape[1]))
    texts = ["Some words, 12 in all", "é", "", "!!", "straße über ÄÖ"]
    raw = [t.encode() for t in texts]
    lang, score, ambiguous = model.predict(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    for t, v, s, unclear in zip(texts, lang, score, ambiguous, strict=True):
        if not any(c.isalpha() for c in t):
            assert (v, s, unclear) == ("und", 0.0, True)
            continue
        margin = model.bias.copy()
        for n in langid.ORDERS:
            grams = brute_grams(t, n)(langid.BITS)
            for g in grams:
                margin += weights[g].astype(float) / len(grams)
        loss = [sum(model.trust[b] * np.log1p(np.exp(-code[k, b] * margin[b])) for b in range(code.shape[1])) for k in range(7)]
        p = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        assert v == f"l{p.argmax()}" and abs(s - p.max()) < 1e-6 and unclear == (np.sort(p)[-1] - np.sort(p)[-2] < langid.LEAD)


def test_naive_bayes_scores_equal_brute_force():
    rng = random.Random(4)
    texts = [words(rng, 30, 40) + (" nasty thing" if i % 3 == 0 else " kind word") for i in range(60)]
    model = toxicity.Model.fit(texts, [int(i % 3 == 0) for i in range(60)], 0.5)
    assert (model.weights != 0).any()
    for t in [*texts[:6], "", "nasty NASTY nasty"]:
        held = {g for n in toxicity.ORDERS for g in brute_grams(t, n)(toxicity.BITS)}
        z = model.bias + sum(float(model.weights[g]) for g in held)
        raw = np.frombuffer(t.encode(), np.uint8)
        assert abs(model.score(raw, np.array([0, len(raw)]))[0] - 1 / (1 + np.exp(-z))) < 1e-6


def test_toxicity_scores_are_calibrated_on_texts_left_out():
    rng = random.Random(11)
    toxic = [i % 4 == 0 for i in range(900)]
    texts = [words(rng, 40, 60) + (" nasty" if (bad and rng.random() < 0.8) or rng.random() < 0.02 else "") for bad in toxic]
    labels = [int(bad if rng.random() > 0.05 else not bad) for bad in toxic]  # some labels are wrong
    model = toxicity.Model.fit(texts[:600], labels[:600], sum(labels[:600]) / (600 - sum(labels[:600])))
    raw = [t.encode() for t in texts[600:]]
    p = model.score(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    held, sure = np.array(labels[600:]), p >= toxicity.THRESHOLD
    assert abs(p.mean() - held.mean()) < 0.06 and abs(p[sure].mean() - held[sure].mean()) < 0.15
    has = np.array([t.endswith("nasty") for t in texts[600:]])
    assert (sure == has).mean() > 0.97
    few = toxicity.Model.fit(texts[:8], [1, 0, 0, 0, 1, 0, 0, 0])  # too few to leave any out
    assert np.isfinite(few.weights).all() and np.isfinite(few.bias)


def test_long_texts_are_classified_in_parts():
    rng = random.Random(5)
    long = "é" + words(rng, 600_000, 5000) + " nasty thing ü"
    raw = np.frombuffer(long.encode(), np.uint8)
    whole, _ = langid.frequencies(raw, np.array([0, len(raw)]), np.r_[np.eye(1 << langid.BITS, 8), np.zeros((1, 8))])
    assert len(raw) > 3 << 20 and np.allclose(langid.histogram(raw)[0][:8], whole[0])
    model = toxicity.Model.fit([words(rng, 30, 40) + (" nasty thing" if i % 3 == 0 else " kind word") for i in range(60)], [int(i % 3 == 0) for i in range(60)])
    _, bucket = toxicity.present(raw, np.array([0, len(raw)]), model.weights != 0)
    z = model.weights[bucket].sum(dtype=float) + model.bias
    assert abs(model.score(raw, np.array([0, len(raw)]))[0] - 1 / (1 + np.exp(-np.clip(z, -40, 40)))) < 1e-6


def test_codewords_are_far_apart():
    for k in (2, 3, 4, 5, 9, 20):
        code = langid.codewords(k)
        gap = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
        assert gap >= (1 if k == 2 else 2) and (k < 4 or gap >= 4)


@pytest.fixture(scope="module")
def labelled_docs(spark):
    rng, docs, labels = random.Random(2), [], []
    for i in range(240):
        bad, junk = i % 4 == 0, i % 5 == 0
        w = [f"word{rng.randrange(200)}" for _ in range(rng.randrange(20, 80))]
        if bad:
            w[rng.randrange(len(w))] = w[rng.randrange(len(w))] = "nastything"
        docs.append(document(i, " ".join(x.upper() + "!!" if junk else x for x in w) + "."))
        labels.append((i, int(not junk), int(bad)))
    docs += [document(500, None), document(501, ""), document(502, "nastything " * 20_000), document(502, "word")]
    labels += [(None, 1, 1), (3, None, None), (777, 1, 0)]
    return spark.createDataFrame(docs, DOCS).withColumn("score", F.lit(1)).withColumn("_v", F.lit(2)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, labelled_docs):
    docs, labels = labelled_docs
    model = toxicity.fit(docs, labels, F.col("doc_id") % 3 != 0)
    got = [(r["doc_id"], r["score"], r["predicted"]) for r in toxicity.score(docs, model).collect()]
    assert len(got) == 244 and all(0 <= s <= 1 and p == int(s >= 0.3) for _, s, p in got)
    assert all(p == int(i % 4 == 0) for i, _, p in got if i < 240)
    assert sorted(p for i, _, p in got if i == 502) == [0, 1]
    assert toxicity.score(docs.limit(0), model).count() == 0
    single = toxicity.fit(docs, labels.filter("toxic = 1"), F.lit(True))
    assert all(r["predicted"] == 1 for r in toxicity.score(docs, single).collect())


def test_quality(spark, labelled_docs):
    docs, labels = labelled_docs
    docs = docs.drop("_v")
    model = quality.fit(docs, labels, F.col("doc_id") % 3 != 0)
    got = [(r["doc_id"], r["score"], r["predicted"]) for r in quality.score(docs, model).collect()]
    assert len(got) == 244 and all(0 <= s <= 1 for _, s, _ in got)
    assert np.mean([p == int(i % 5 != 0) for i, _, p in got if i < 240]) > 0.97
    assert quality.accepted(docs, model).columns == docs.columns
    assert quality.score(docs.limit(0), model).count() == 0
    names = list(quality.shares())
    row = quality.with_statistics(docs.filter("doc_id < 40")).select(model.column({k: F.col(f"_v.{k}") for k in names}).alias("p"), "_v.*").collect()
    for r in row:  # the compiled expression is the sum of the rules that hold
        x = np.array([[r[k] for k in names]])
        z = model.bias + sum(rule.weight * rule.holds(x, names)[0] for rule in model.rules)
        assert abs(r["p"] - 1 / (1 + np.exp(-z))) < 1e-9


def test_statistics_of_a_text(spark):
    df = spark.createDataFrame([("Aa aa b, b b\n1 é!",), (None,)], "text string")
    got = quality.with_statistics(df).select("_v.*").collect()
    assert got[0]["doubled"] == 1 / 7 and got[0]["distinct"] == 5 / 7 and got[0]["capitals"] == 1 / 8 and got[0]["digits"] == 1 / 17
    assert got[1]["chars"] == 0 and got[1]["letters"] == 0


# token counts


def counter(tmp_path):
    import public_tokenizers

    return token_counts.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_edited_counts_equal_full_encoding(tmp_path):
    own, rng = counter(tmp_path), random.Random(6)
    for text in ("", "  ", "it's a\n\n line  ", "é" * 50, "".join(rng.choice("ab  \n'st9.,") for _ in range(3000))):
        tree = token_counts.Tree(*own.measured(text))
        for _ in range(60):
            a = rng.randrange(len(text) + 1)
            b = a + rng.choice([0, 0, 1, 3, 200])
            new = "".join(rng.choice("ab 'st\n \t9é.中") for _ in range(rng.choice([0, 1, 4, 300])))
            edited = tree.edit(text, a, b, new, own)
            assert edited == text[:a] + new + text[b:]
            text = edited
            assert tree.total == len(own.encode(text)) and tree.pieces == len(own.split(text))


def test_token_counts_in_frames(spark):
    import public_tokenizers

    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    own = token_counts.Counter(*args)
    texts = ["some words here, and more of them " * 300, "", None, "x", "x"]
    docs = spark.createDataFrame([(i if i < 4 else 3, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    states = token_counts.build(docs, *args)
    assert sorted(r["n_tokens"] for r in states.collect()) == sorted(len(own.encode(t or "")) for t in texts)
    edits = spark.createDataFrame([(0, [(5, 9, "new"), (10**6, 10**6, " end"), (-5, 0, None)])], "doc_id long, edits array<struct<start:int,end:int,text:string>>")
    given = docs.select("doc_id", "text").join(states, "doc_id").join(edits, "doc_id", "left")
    for r in token_counts.apply(given, *args).collect():
        assert r["n_tokens"] == len(own.encode(r["text"])) and r["n_encoded"] < 40
    revised = sorted(tuple(r)[1:] for r in token_counts.revise(docs, token_counts.sample_revision(), *args).collect())
    want = []
    for text in (t or "" for t in texts):  # the same edits on the text, encoded whole
        edited = text
        for part, wide, new in ((0.75, 5, "Edited"), (0.5, 0, " as amended, 2026"), (0.25, 7, "")):
            at = int(len(text) * part)
            edited = edited[:at] + new + edited[at + wide :]
        want.append((len(own.encode(text)), len(own.encode(edited)), len(own.split(text))))
    assert [r[:3] for r in revised] == sorted(want) and all(r[3] < 60 for r in revised)
    assert token_counts.build(docs.limit(0), *args).count() == 0


# neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 24))
    x[100:1100] = x[100]  # a third of all rows is one vector
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000, None, 1), (5001, [0.0] * 24, 1), (5050, [float("nan")] + [1.0] * 23, 1), (5100, [None] + [1.0] * 23, 1), (5150, [1.0], 1), (None, [1.0] * 24, 1), (5200, [float("inf")] + [1.0] * 23, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 3000, 50))
    u, hit = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q, found in got.items():
        near = ann.cosine(x[q][None], x)
        near[q] = -9
        best = np.lexsort((np.arange(len(x)), -near))[:5]
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(abs(s - near[i]) < 1e-12 for _, i, s in found)
        hit += len({f[1] for f in found} & set(best.tolist()))
    assert hit / (5 * len(got)) >= 0.9
    assert [f[1] for f in got[150]] == [100, 101, 102, 103, 104]
    few = ann.search(df.filter("vec_id < 3"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert ann.search(df.filter("vec_id = 5001"), F.lit(True)).count() == 0


def test_more_rows_than_the_sample_and_large_components(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 6000)] + 0.5 * rng.normal(size=(6000, 16))
    size = 10.0 ** rng.integers(-200, 200, 6000)
    df = spark.createDataFrame([(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(x, size, strict=True))], "vec_id long, embedding array<double>")
    got, hit = {}, 0
    for r in ann.search(df, F.col("vec_id") % 50 == 0, sample=500).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert ann.Index.fit(ann.unit(x[:500]), 6000).fine is not None
    for q, found in got.items():
        near = ann.cosine(x[q][None], x)
        near[q] = -9
        assert all(abs(s - near[i]) < 1e-12 for _, i, s in found)
        hit += len({f[1] for f in found} & set(np.lexsort((np.arange(len(x)), -near))[:5].tolist()))
    assert len(got) == 120 and hit >= 0.9 * 600
    wide = np.array([[1e200, 2e200], [2e-200, 4e-200], [5e-324, 0.0]])
    assert np.allclose(ann.cosine(wide[0][None], wide), [1, 1, 1 / np.sqrt(5)])


def test_neighbours_behind_many_rows_of_one_code(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 24))
    x = np.r_[centres.repeat(700, axis=0) + 1e-4 * rng.normal(size=(2800, 24)), rng.normal(size=(200, 24))]
    unit = ann.unit(x)
    middles = ann.kmeans(unit, 2, 8, rng)
    rest = unit - middles[ann.nearest(unit, middles)]
    edges = np.linspace(0, 24, ann.PIECES + 1).astype(int).tolist()
    index = ann.Index(middles, [ann.kmeans(rest[:, a:b], 8, 8, rng) for a, b in zip(edges, edges[1:], strict=False)], edges)
    index.tune(unit, rng)
    assert index.rerank > 600
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, hit = {}, 0
    for r in ann.search(df, F.col("vec_id") % 50 == 0, index=index).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in range(0, 3000, 50):
        near = ann.cosine(x[q][None], x)
        near[q] = -9
        hit += len(got[q] & set(np.lexsort((np.arange(len(x)), -near))[:5].tolist()))
    assert hit >= ann.RECALL * 5 * len(got)
    index.tune(unit, rng, 50.0)
    assert index.rerank > 600 * 50


# sharding


def test_shards_are_even_and_keep_copies_together(spark):
    rng = random.Random(9)
    docs = [(i, "x" * rng.randrange(200)) for i in range(3000)] + [(i, "copied text " * 9) for i in range(3000, 4500)] + [(5000, None), (5001, None), (5001, None), (5002, "é" * 2000), (None, "n")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, slot int")
    got = sharding.assign(df).collect()
    assert len(got) == len(docs)
    load = {}
    for r in got:
        load.setdefault(r["shard"], []).append(r)
    assert sorted(load) == list(range(24))
    sizes = [sum(r["size"] for r in v) for v in load.values()]
    assert max(sizes) < 1.02 * sum(sizes) / 24
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in load.values())
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in docs)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    homes = {}
    for r in got:
        if r["text_crc32"] not in (0, zlib.crc32(b"copied text " * 9)):  # null and empty are two groups
            homes.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(v) == 1 for v in homes.values())
    assert sharding.assign(df.limit(0)).count() == 0


def test_map_edits_move_little(spark, tmp_path):
    rng = random.Random(4)
    size = [rng.randrange(1000) for _ in range(4096)]
    first = sharding.SlotMap.first(size, 24)
    assert first.edited(size).shard_of == first.shard_of
    grown = first.edited(size, 25)
    moved = [s for s in range(4096) if first.shard_of[s] != grown.shard_of[s]]
    assert all(grown.shard_of[s] == 24 for s in moved) and len(moved) < 4096 / 20
    shrunk = grown.edited(size, 24)
    assert set(shrunk.shard_of) == set(range(24)) and shrunk.version == 3
    grown.store(spark, f"file://{tmp_path}/map")
    assert sharding.SlotMap.load(spark, f"file://{tmp_path}/map", 2).shard_of == grown.shard_of


# packing


def test_pieces_make_up_all_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(7)
    texts = [words(rng, rng.randrange(1, 400), 3000) for _ in range(60)] + [None, "", " ", "İΣΑΣ ½ don't I'LL <|endoftext|> 中文 b\x1cc é́", words(rng, 6000), "same", "same"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(3)
    got = packing.pack(docs, path).toPandas()
    model = Tokenizer.from_file(path)
    for i, text in enumerate(texts):
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in got[got.doc_id == i].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]] and len(s) <= packing.SEGMENTS
        n = int(s.length.sum())
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding <= 3 * 2048
    assert packing.pack(docs.limit(0), path).count() == 0


def test_conversations_pack_under_three_limits(spark):
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(14)
    said = [(c, t, ("user", "assistant")[t % 2], words(rng, rng.randrange(1, 60), 3000)) for c in range(150) for t in range(rng.randrange(1, 7))]
    said += [(900, 0, "user", "only a question"), (901, 0, "assistant", None), (902, 0, "assistant", "said " * 400)]
    chats = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    if os.path.isdir(d := "/root/testdata/sf0.001"):
        chats = chats.unionByName(spark.read.parquet(f"{d}/conversations.parquet").withColumn("conv_id", F.col("conv_id") + 5000).select(chats.columns))
    formatted = chat.format_chats(chats).coalesce(2)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(formatted, path, "conv_id", "formatted", tokens=256, segments=4, loss_tokens=100, loss="loss_spans").toPandas()
    model = Tokenizer.from_file(path)
    encode = lambda t: model.encode(t, add_special_tokens=False).ids
    for r in formatted.collect():
        ids, bears, at = [], [], 0
        for s in r["loss_spans"]:
            for part, flag in ((r["formatted"][at : s["start"]], 0), (r["formatted"][s["start"] : s["end"]], 1)):
                ids += encode(part)
                bears += [flag] * (len(ids) - len(bears))
            at = s["end"]
        ids += encode(r["formatted"][at:])
        bears += [0] * (len(ids) - len(bears))
        ids, bears, at = np.array([*ids, 1], "<u4"), [*bears, int(any(bears))], 0
        for p in got[got.conv_id == r["conv_id"]].sort_values("start").itertuples():
            assert (p.start, p.doc_tokens, p.ids_crc32, p.loss_length) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()), sum(bears[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    of = got.groupby("sequence_id").agg(tokens=("length", "sum"), segments=("length", "size"), loss=("loss_length", "sum"))
    assert (of.tokens <= 256).all() and (of.segments <= 4).all() and (of.loss <= 100).all()
    assert (of.tokens == 256).any() and (of.segments == 4).any() and (of.loss == 100).any()


def test_long_texts_are_encoded_in_parts(tmp_path):
    import public_tokenizers

    rng = random.Random(15)
    encode = packing.UnitTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    text = words(rng, 700_000, 3000) + "\n" + "é" * 3000
    assert len(text) > 3 << 20
    assert (encode([text.encode()])[0] == np.concatenate([encode([w.encode()])[0] for w in text.split("\n")])).all()
    assert encode.model.encode(text[-300_000:], add_special_tokens=False).ids == encode([text[-300_000:].encode()])[0].tolist()
    own = counter(tmp_path)
    sizes, tokens = own.measured(text)
    assert sum(sizes) == len(text) and sum(tokens) == len(own.encode(text)) and len(sizes) == len(own.split(text))


def test_all_three_limits_hold():
    rng = np.random.default_rng(3)
    packer, out = packing.Packer((100, 4, 60), 16, 0), []
    docs = {i: (rng.integers(0, 9, n).astype(np.int32), rng.random(n) < 0.5) for i, n in enumerate(rng.integers(1, 250, 200))}
    for i, (ids, loss) in docs.items():
        out += packer.add(i, ids, loss)
    out += packer.finish()
    whole, load = {i: 0 for i in docs}, {}
    for name, start, ids, total, sequence, offset, bears in out:
        loss = docs[name][1][start : start + len(ids)].sum()
        assert bears == loss
        assert (docs[name][0][start : start + len(ids)] == ids).all()
        whole[name] += len(ids)
        t, s, v = load.get(sequence, (0, 0, 0))
        assert offset == t
        load[sequence] = t + len(ids), s + 1, v + loss
    assert all(whole[i] == len(d[0]) for i, d in docs.items())
    assert all(t <= 100 and s <= 4 and v <= 60 for t, s, v in load.values())


# shared parts, registration, pipeline


def test_steps_and_rolling_hashes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "", "c" * 50, "é"])], ["text"]).slice(1)
    assert [(p.num_rows, bytes(raw).decode()) for p, raw, _ in steps(iter([batch]), "text", 10)] == [(2, ""), (1, "c" * 50), (1, "é")]
    values = np.arange(50, dtype=np.uint64) % 7
    h = Powers(0x9E3779B97F4A7C15).spans(values, np.arange(40), np.arange(40) + 7)
    assert (h[:33] == h[7:]).all() and len(set(mix(h[:7]).tolist())) == 7


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names


def test_pipeline_stages(spark):
    import os

    import corpus_pipeline
    from loomstack.llm.common import materialize, table

    if not os.path.isdir(d := "/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    docs = table(spark, d, "documents")
    extra = spark.createDataFrame([document(90_000, None), document(90_001, "123 456")], DOCS)
    docs, columns = docs.unionByName(extra), docs.columns
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, d), name)
        kept.append(docs.select("doc_id").distinct().count())
        if name != "packing":
            assert docs.columns == columns
        if name == "language_id":
            assert docs.filter("doc_id >= 90000").count() == 0
        if name == "near_duplicates":
            own = simhash.near_duplicates(before).collect()
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {r["component_id"] for r in own}
        if name == "decontamination":
            bench = [(r["item_id"], r["text"]) for r in table(spark, d, "benchmark").collect()]
            want = brute_hits([(r["doc_id"], r["text"]) for r in before.collect()], bench)
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {b[0] for b in want if not b[5]}
    assert kept[0] - 2 == kept[1] and kept == sorted(kept, reverse=True) and kept[4] == kept[5]
    assert json.dumps(kept)


def test_the_pipeline_drops_texts_without_one_language(spark):
    import corpus_pipeline

    rng = random.Random(8)
    stock = {"xx": "the of and ing", "yy": "der die ung sch", "zz": "que ión los ñas"}
    say = lambda v, n: " ".join(rng.choice(stock[v].split()) for _ in range(n))
    docs = [document(i, say(v, rng.randrange(20, 60)), v) for i, v in enumerate(sorted(stock) * 40)]
    mixed = [document(1000 + i, " ".join(say(v, 1) for _ in range(30) for v in ("xx", "yy")), None) for i in range(10)]
    stays = {r["doc_id"] for r in corpus_pipeline.language(spark, spark.createDataFrame(docs + mixed, DOCS), "").collect()}
    assert {d[0] for d in docs} <= stays and len(stays) < len(docs) + 5


# large inputs and hot groups


def test_a_benchmark_block_is_small_and_several_equal_one():
    import tracemalloc

    rng = random.Random(21)
    stock = [f"w{rng.randrange(10**6)}x" for _ in range(100_000)]
    items = [(str(i), " ".join(rng.choices(stock, k=60))) for i in range(35_000)]
    assert sum(len(t) for _, t in items) > 15 << 20
    tracemalloc.start()
    tests = decontaminate.TestSet(items, 13)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30 and tests.nbytes() < 150 << 20
    tracemalloc.stop()
    text = " ".join(rng.choices(stock, k=200)) + " " + items[77][1].upper()
    raw = np.frombuffer(text.encode(), np.uint8)
    assert [(r["items"], r["spans"][0]["words"], r["spans"][0]["first"]) for r in tests.scan(raw, np.array([0, len(raw)]))] == [(["77"], 60, 200)]


def test_long_texts_are_scanned_in_pieces():
    rng = random.Random(22)
    items = [("a", words(rng, 40, 9000)), ("b", "z" * (3 << 20)), ("c", words(rng, 13, 9000)), ("d", words(rng, 2, 9000)), ("e", "big " + "y" * (2 << 20) + " end")]
    tests = decontaminate.TestSet(items, 13)
    for text in (items[0][1], words(rng, 900_000, 9000) + " " + items[0][1] + " " + words(rng, 300_000, 9000) + "," + "Z" * (3 << 20) + " " + items[2][1] + " é " + items[3][1], "y" * (2 << 20) + " " + items[4][1]):
        raw = np.frombuffer(text.encode(), np.uint8)
        got = tests.scan(raw, np.array([0, len(raw)]))[0]
        want = brute_hits([(0, text)], items)[0]
        assert (got["n_words"], sum(s["words"] for s in got["spans"]), hashlib.sha256(",".join(got["items"]).encode()).hexdigest()) == (want[1], want[2], want[4])
        for s in got["spans"]:
            assert len(re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode()[s["start"] : s["end"]])) == s["words"]


def test_no_slot_holds_a_hot_group(spark):
    rng = random.Random(10)
    docs = [(i, words(rng, 20, 5000)) for i in range(9000)] + [(i, None) for i in range(9000, 15_000)] + [(-1, "the same row")] * 3000
    got = sharding.assign(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).toPandas()
    assert len(got) == len(docs)
    assert got.groupby("virtual_slot").size().max() <= len(docs) / 48
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in got.groupby("shard"))
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 24 and load.max() < 1.02 * load.mean()
