"""The corpus operators against brute force, round trips and edge cases on small fixtures."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as tokens
import pytest
from pyspark.sql import functions as F

from cellweave.llm import chat, decontaminate, langid, multiindex, neardup, packing, pii, tokencount, warc
from cellweave.llm.queries import byte_bpe
from cellweave.session import fresh_path

DOCS = "doc_id long, text string, lang string, key string"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "en", "x") for k, t in texts], DOCS)


def naive_base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15)]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, t) if ok(m[0])]


def test_pii_base_rules():
    rng = random.Random(1)
    parts = ["a@b.c", "@", "x.y+z@q-r.co.uk", "10.0.0.1", "256.1.1.1.1", "4111 1111 1111 1111", "4111-1111", "+1 (555) 010-9999", " ", ".", "é", "7", "-", "+"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        base, spans = pii.all_spans(t)
        assert base == naive_base(t), t
        assert set(base) <= set(spans)


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("write to jane (at) mail (dot) example (dot) org today", "email", "jane (at) mail (dot) example (dot) org"),
    ("write jane at example dot org now", "email", "jane at example dot org"),
    ("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｏｒｇ", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｏｒｇ"),
    ("call +1 five five five zero one zero nine nine nine nine!", "phone", "+1 five five five zero one zero nine nine nine nine"),
    ("host ten: one nine two dot one six eight dot one dot one.", "ip", "one nine two dot one six eight dot one dot one"),
    ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１")])
def test_pii_disguises(text, kind, found):
    base, spans = pii.all_spans(text)
    assert [(k, text[a:b]) for k, a, b in spans] == [(kind, found)] and not base


def test_pii_leaves_prose_alone_and_takes_long_texts():
    assert pii.all_spans("He arrived at the dot on one page. Look at two dots.")[1] == []
    long = "1" * 200_000 + "." * 1000 + "+" * 1000 + "a" * 100_000 + "@"
    assert pii.all_spans(long) == ([], [])


def test_pii_rows(spark):
    got = {r.doc_id: r for r in pii.report(docs_of(spark, [(1, None), (2, ""), (3, "a@b.c"), (None, "a@b.c")])).collect()}
    assert got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].spans == "email:0:5" and got[None].n_email == 1
    assert pii.report(docs_of(spark, [])).count() == 0


def test_language(spark):
    rng = random.Random(2)
    vocab = {"aa": ["lorem", "ipsum", "dolor", "sit", "amet"], "bb": ["zwölf", "boxkämpfer", "jagen", "viktor", "quer"]}
    rows = [(k, " ".join(rng.choice(vocab[lang]) for _ in range(40)), lang, "") for k in range(80) for lang in [("aa", "bb")[k % 2]]]
    rows += [(100, None, "aa", ""), (101, "123 !!", None, ""), (102, "", "bb", ""), (103, rows[0][1], None, "")]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in langid.report(spark, df).collect()}
    assert all(got[k].lang_pred == lang and 0 < got[k].score <= 1 for k, _, lang, _ in rows[:80])
    assert [got[k].lang_pred for k in (100, 101, 102, 103)] == ["und", "und", "und", "aa"]
    model = langid.fit(langid.training_rows(df))
    far = {r.doc_id: r.rejected for r in langid.identify(docs_of(spark, [(1, "ξψω " * 300), (2, None), (3, rows[1][1])]), model).collect()}
    assert far == {1: True, 2: True, 3: False}
    none = langid.identify(df, langid.fit(df.limit(0)))
    assert none.columns == [*df.columns, "lang_pred", "score", "rejected"] and {r.lang_pred for r in none.collect()} == {"und"}


def test_copies_take_no_place_in_the_language_sample(spark):
    rows = [(k, "lorem ipsum dolor sit amet " * 5, "aa", "") for k in range(3000)]
    rows += [(4000 + k, f"zwölf boxkämpfer jagen viktor quer {'ij' * k}", "aa", "") for k in range(3)]
    model = langid.fit(spark.createDataFrame(rows, DOCS), clusters=4, sample=4)
    assert len(model.langs) == 4  # one centroid for each of the four distinct texts


def test_odd_training_texts_let_no_other_language_pass(spark):
    rng = random.Random(3)
    own = {"en": "the house stood at the edge of a small village where people would come together when evening fell and tell their stories about what had happened during that long day which nobody could forget because everything changed after winter",
           "de": "das haus stand am rande eines kleinen dorfes wo sich die menschen abends trafen und ihre geschichten erzählten über alles was während des langen tages geschehen war und niemand vergessen konnte weil sich nach dem winter vieles änderte"}
    text = lambda lang: " ".join(rng.choice(own[lang].split()) for _ in range(120))
    rows = [(k, text(lang), lang, "") for k in range(400) for lang in [("en", "de")[k % 2]]]
    rows += [(1000 + k, f"{w} " * 150, lang, "") for lang in own for k, w in enumerate("of qzx jklö wvw uhu pfpf yoyo 漢字".split())]
    model = langid.fit(spark.createDataFrame(rows, DOCS))
    other = ["La casa era grande e bianca, con un giardino pieno di fiori che il nonno curava ogni mattina. I bambini correvano tra gli alberi mentre la madre preparava il pranzo in cucina.",
             "Talo seisoi kylän laidalla, missä tie kulki joen vartta ja lapset leikkivät joka päivä aamusta iltaan asti."]
    assert model.predict(other)["rejected"].all() and model.predict([3 * t for t in other])["rejected"].all()
    assert not model.predict([text(lang) for lang in own for _ in range(20)])["rejected"].any()


def test_packing(spark):
    rng = random.Random(4)
    word = ["alpha", "beta", " gamma", "日本", "<|endoftext|>", "é", "\n"]
    texts = [(k, " ".join(rng.choice(word) for _ in range(rng.choice([0, 1, 5, 60, 400])))) for k in range(60)] + [(70, None), (3, "x"), (3, "x")]
    got = packing.pack_documents(docs_of(spark, texts), *byte_bpe(), packing.Capacity(tokens=128, documents=9, cost=20000)).toPandas()
    whole = packing.Encoder(tokens.path("byte_bpe_50k.json"))
    want = []
    for k, t in texts:
        ids = np.append(whole.whole.encode(t or "", add_special_tokens=False).ids, 0).astype("<u4")
        cuts = [0, *range((len(ids) - 1) % 128 + 1, len(ids) + 1, 128)]
        want += [(k, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(want) == sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]
        assert g.length.sum() <= 128 and len(g) <= 9
    assert packing.pack_documents(docs_of(spark, []), *byte_bpe()).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_is_best_fit_piece_by_piece(rule):
    """The plan by classes against plain best fit of single pieces."""
    rng = random.Random(5)
    for _ in range(30):
        cap = packing.Capacity(tokens=60, documents=6, cost=2500, rule=rule, weights=(1.0, 0.0, 0.0))
        histogram = {k: rng.randint(1, 7) for k in rng.sample(range(1, 50), 12)}
        rows = packing.plan(histogram, cap)
        bins: dict[int, list[int]] = {}
        for length, _, n, first, each, offset in rows:
            for k in range(n):
                bins.setdefault(first + k // each, []).append(length)
                assert sum(bins[first + k // each][:-1]) == offset + k % each * length
        assert sorted(x for b in bins.values() for x in b) == sorted(k for k, n in histogram.items() for _ in range(n))
        assert all(sum(b) <= 60 and len(b) <= 6 and sum(x * x for x in b) <= 2500 for b in bins.values())
        plain: list[list[int]] = []
        for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
            fits = [b for b in plain if sum(b) + length <= 60 and len(b) < 6 and sum(x * x for x in b) + length * length <= 2500]
            (max(fits, key=sum) if fits else plain.append([]) or plain[-1]).append(length)
        assert len(bins) <= len(plain) + 1


def test_token_counts_and_cache(spark):
    path, cache = tokens.path("piece_bpe_32k.model"), fresh_path(spark, "cache-test")
    texts = [(1, "hello world"), (2, None), (3, ""), (4, "hello world"), (5, "<s> 日本 </s>" * 50), (None, "x")]
    count = tokencount.counter(path)
    want = {(k, len((t or "").encode()), n, n > 20) for (k, t), n in zip(texts, count([t or "" for _, t in texts]), strict=True)}
    for size in (4, 4):  # the second run finds everything in the cache
        got = {tuple(r) for r in tokencount.count_tokens(docs_of(spark, texts), path, cache, limit=20).collect()}
        assert got == want and spark.read.parquet(cache).count() == size
    tokencount.count_tokens(docs_of(spark, [(1, "new")]), path, cache)
    assert spark.read.parquet(cache).count() == 5
    other = tokens.path("byte_bpe_50k.json")
    tokencount.count_tokens(docs_of(spark, [(1, "new")]), other, cache)
    assert spark.read.parquet(cache).count() == 6
    assert tokencount.count_tokens(docs_of(spark, []), path, fresh_path(spark, "cache-test")).count() == 0


def brute_components(texts, words, percent):
    sets = []
    for _, t in texts:
        w = [x for x in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    ids = [k for k, _ in texts]
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for a in range(len(ids)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {(k, len(s), c) for k, s, c in zip(ids, sets, label, strict=True)}


def test_near_duplicates(spark):
    rng = random.Random(6)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(120)] for _ in range(6)]
    texts = []
    for k in range(110):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"V{rng.randint(0, 9)}"
        texts.append((k, rng.choice([" ", "\n", "\t "]).join(w)))
    texts += [(200, None), (201, ""), (202, "Two words"), (203, "two WORDS"), (204, "é É a b"), (205, "  ")]
    got = neardup.report(docs_of(spark, texts), words=4).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(texts, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = neardup.drop_near_duplicates(docs_of(spark, texts), words=4)
    assert kept.columns == ["doc_id", "text", "lang", "key"] and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_near_duplicates_edge_rows(spark):
    rows = neardup.report(docs_of(spark, [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e")]), words=4).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert neardup.report(docs_of(spark, []), words=4).count() == 0


def test_a_repeated_doc_id_keeps_its_other_text(spark):
    docs = docs_of(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (2, "quite another text of its own"), (2, None)])
    got = neardup.drop_near_duplicates(docs, words=4).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == [(1, "a b c d e f"), (2, ""), (2, "quite another text of its own")]


def test_bytes_equal_by_chance_hide_no_link(spark):
    rng = np.random.default_rng(5)
    while True:  # until a band before the first common one agrees in its bytes alone
        pool = np.unique(rng.integers(0, 1 << 63, 330).astype(np.uint64))
        sets = [pool[:-15], pool[15:]]
        sigs = [neardup.signature(x, neardup.BANDS * neardup.ROWS) for x in sets]
        keys = [neardup.band_keys(x, neardup.BANDS, neardup.ROWS) for x in sigs]
        octets = [x.astype(np.uint8) for x in sigs]
        common = np.flatnonzero(keys[0] == keys[1])
        if len(common) and (octets[0] == octets[1]).reshape(neardup.BANDS, -1).all(axis=1).argmax() < common[0]:
            break
    rows = [(k + 1, 315, octets[k].tobytes(), keys[k].tolist(), sets[k].tobytes()) for k in (0, 1)]
    classes = spark.createDataFrame(rows, "node long, n long, bytes binary, bands array<long>, items binary")
    placed = classes.select(F.explode("bands").alias("bucket"), "node", F.col("node").alias("component"))
    got = neardup.across(placed, classes.drop("items"), classes.select("node", "items"), 80).collect()
    assert {(r.component, r.root) for r in got} == {(1, 1), (2, 1)}


def test_short_forms_never_hide_a_link():
    rng = np.random.default_rng(8)
    for n in (3, 40, 3000, 60_000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: int(0.9 * len(x))], rng.integers(0, 1 << 63, max(1, n // 12)).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if 100 * common >= 80 * (len(x) + len(y) - common):
            short = [np.unique(s.astype(np.uint16)) for s in (x, y)]
            assert neardup.may_link(*short, len(x), len(y), 80)


def test_warc_round_trip(spark):
    pages = [(1, "http://a", "x" * 2000, "z"), (2, None, "x" * 2000, "z"), (3, "http://b\r\n", "é" * 700, "z"), (4, "u", "small", "z"), (5, "u", "small", "z"),
             (6, "u", None, "z"), (7, "u", "x" * 2000, "z"), (7, "u", "x" * 2000, "z"), (None, "u", "x" * 2000, "z"), (8, "u", "<p>\r\n\r\nWARC/1.1\r\n" * 90, "z")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload string")
    got = sorted((tuple(r) for r in warc.report(df).collect()), key=repr)
    want = []
    for k, _, html, _ in pages:
        data = (html or "").encode()
        to = 7 if html == "x" * 2000 and k != 7 else None
        want.append((k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to else "response", to))
    assert got == sorted(want, key=repr)
    assert warc.report(df.limit(0)).count() == 0


def test_warc_records_stand_alone():
    records = [warc.record(k, f"http://x/{k}", f"<p>page {k} of many</p>".encode() * 40, None, "1970-01-01T00:00:00Z") for k in range(300)]
    data = warc.archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    back = list(warc.unpacked(io.BytesIO(data)))
    assert len(back) == 300 and back[7][1].endswith(b"<p>page 7 of many</p>" * 40)
    assert len(data) < sum(map(len, records)) / 4


@pytest.mark.parametrize("most", [500_000, 4, 0])
def test_decontamination_edges(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", most)
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item, "a"), (2, "Short ITEM", "a"), (3, None, "a"), (4, "...", "a"), (None, "lonely", "a"), (1, item, "a")],
                                  "item_id long, text string, spans string")
    texts = [(1, "x " + item.upper() + " y"), (2, item[:-7]), (3, "a short-item b"), (4, None), (5, ""), (6, "LONELY"), (7, "nothing here"), (1, "x " + item.upper() + " y"),
             (8, " ".join(item.split()[:9]))]
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs_of(spark, texts), bench).collect())
    assert got == sorted([(1, 13, 11, 1, True), (1, 13, 11, 1, True), (2, 10, 10, 1, True), (3, 4, 2, 1, True), (4, 0, 0, 0, False), (5, 0, 0, 0, False),
                          (6, 1, 1, 0, True), (7, 2, 0, 0, False), (8, 9, 0, 0, False)])
    kept = decontaminate.decontaminate(docs_of(spark, texts), bench)
    assert kept.columns == ["doc_id", "text", "lang", "key"] and sorted(r.doc_id for r in kept.collect()) == [4, 5, 7, 8]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs_of(spark, texts), bench, remove="spans").collect()}
    assert cut[1] == "x y" and cut[3] == "a b" and cut[4] is None and cut[7] == "nothing here"
    assert decontaminate.contamination(docs_of(spark, texts), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs_of(spark, []), bench).count() == 0


def test_many_hits_in_one_document_are_cut_in_linear_time(spark):
    bench = spark.createDataFrame([(1, "hit"), (2, "two words")], "item_id long, text string")
    text = " ".join("hit so" if k % 2 else "two words here" for k in range(40_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    cut = decontaminate.decontaminate(df, bench, remove="spans").first().text
    assert cut.split() == ["here", "so"] * 20_000
    got = decontaminate.contamination(df, bench).first()
    assert (got.n_words, got.n_hit, got.n_items) == (100_000, 60_000, 2)


@pytest.mark.parametrize("most", [500_000, 4, 0])
def test_decontamination_takes_words_once(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", most)
    bench = spark.createDataFrame([(k, f"item {k} of five") for k in range(5)], "item_id long, text string")
    texts = [(k, f"no. {k}: Item {k} of FIVE, 3 of five") for k in range(7)] + [(7, ""), (8, None), (8, None), (9, "item 1"), (10, "item 2 of five")]
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    df = docs_of(spark, texts).withColumn("text", F.udf(seen, "string").asNondeterministic()("text"))
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(df, bench).collect())
    assert read.value == len(texts)
    hit = [(k, 9, 4 if k < 5 else 0, int(k < 5)) for k in range(7)]
    assert got == hit + [(7, 0, 0, 0), (8, 0, 0, 0), (8, 0, 0, 0), (9, 2, 0, 0), (10, 4, 4, 1)]


def test_decontamination_words(spark):
    signs = [chr(c) for c in range(1, 0x250)] + ["\u0130", "\u212a", "\u3000", "\U0001f600"]
    df = spark.createDataFrame([(f"a{c}b",) for c in signs], "text string")
    got = {r.text: r.w for r in df.select("text", decontaminate.words(F.col("text")).alias("w")).collect()}
    assert all(got[f"a{c}b"] == ([f"a{c}b"] if c.isalnum() or ord(c) > 127 else ["a", "b"]) for c in signs)


def test_language_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "abc def", "aa", 7.5, "no", "x")], "doc_id long, text string, lang string, score double, rejected string, lang_pred string")
    model = langid.fit(df)
    kept = langid.accepted(df, model)
    assert kept.columns == df.columns and kept.collect() == df.collect()
    told = langid.identify(df, model)
    assert told.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"] and told.first().lang_pred == "aa"


def test_chat_round_trip(spark):
    rng = random.Random(9)
    bits = ["[INST]", "[/INST]", "</s>", "<s>", "\\", "[\\INST]", "<", "[", " ", "[TEXT]", "é", "\n", "[ROLE]", "/INST]", "a"]
    rows = []
    for conv in range(25):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["system", "user", "assistant", "tool [TEXT] x", None])
            rows.append((conv, turn, role, rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))]), "x"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for conv in range(25):
        mine = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        loss = "".join(b for a, b in mine if a == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_machine(spark):
    orders = {1: "su", 2: "ua", 3: "sua", 4: "au", 5: "uu", 6: "usa", 7: "s"}
    names = {"s": "system", "u": "user", "a": "assistant"}
    rows = [(k, n, names[c], "t") for k, o in orders.items() for n, c in enumerate(o)]
    got = {r.conv_id: r.valid for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False}


def test_embeddings(spark):
    rng = np.random.default_rng(10)
    centre = rng.normal(size=(30, 16))
    x = np.concatenate([centre[rng.integers(0, 30, 300)] + rng.normal(scale=0.05, size=(300, 16)), rng.normal(size=(200, 16))])
    x = np.concatenate([x, x[:20]]).astype(np.float32)
    rows = [(k, [float(c) for c in v], k % 3) for k, v in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [None] + [1.0] * 15, 0), (904, [], 0), (905, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, node int")
    got = {r.vec_id: r for r in multiindex.report(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert sum(got[k].n_links for k in range(len(x))) >= 0.99 * (near.sum() - len(x))
    assert all(got[k].n_links <= near[k].sum() - 1 for k in range(len(x)))
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k in range(900, 906))
    assert all(got[k].component_id == got[500 + k].component_id for k in range(20))
    assert multiindex.report(df.where(F.lit(False))).count() == 0
    assert multiindex.report(df.where("vec_id >= 900")).count() == 6


def test_dense_block_against_pairs():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 8))
    x = np.concatenate([x[rng.integers(0, 12, 900)] + rng.normal(scale=0.02, size=(900, 8)), np.ones((1200, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = rng.choice(2100, 500, replace=False)
    visits = [np.array(sorted(rng.choice(6, rng.integers(0, 5), replace=False)), dtype=np.int64) for _ in own]
    weight, home = rng.integers(1, 4, 2100), rng.integers(0, 6, 2100)
    entries = pd.DataFrame({"node": own, "weight": weight[own], "vec": [x[k].tobytes() for k in own], "visits": visits})
    looks = pd.DataFrame({"node": np.arange(2100), "weight": weight, "vec": [v.tobytes() for v in x], "home": home})
    out = multiindex.compare(entries, looks, 8, 0.95)
    got = out[out["w"].notna()].groupby("a")["w"].sum().to_dict()
    want, group = {}, {}
    find = lambda k: k if group.get(k, k) == k else find(group[k])
    near = x @ x[own].T >= 0.95
    for a, e in np.argwhere(near):
        b = int(own[e])
        if a != b:
            want[a] = want.get(a, 0) + int(weight[b])
            if home[a] not in visits[e]:
                want[b] = want.get(b, 0) + int(weight[a])
            r, s = sorted((find(int(a)), find(b)))
            group[s] = r
    assert got == want
    reached = {}
    root = lambda k: k if reached.get(k, k) == k else root(reached[k])
    for a, b in out[out["w"].isna()][["a", "b"]].itertuples(index=False):
        r, s = sorted((root(int(a)), root(int(b))))
        reached[s] = r
    assert all(root(k) == find(k) for k in range(2100))


def test_embeddings_of_any_magnitude(spark):
    rows = [(1, [1e200] * 4), (2, [2e200] * 4), (3, [1e-200] * 4), (4, [1e200, 0.0, 0.0, 0.0]), (5, [5e-324, 0.0, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in multiindex.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4)}
