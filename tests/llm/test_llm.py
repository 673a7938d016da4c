"""Operators for training text: brute force, round trips, held-out accuracy and edge cases."""

import random

import numpy as np
import pandas as pd
import pytest

from colloqua.llm import conversations, defects, encoding, langid, leakage, mixing, pii, queries, subjects
from colloqua.session import table

SF = "/root/testdata/sf0.001"


# 1 personal information


def _finder(given=("anna",), family=("berg", "holm")):
    sets = []
    for terms in (given, family):
        flags = np.zeros(pii.SLOTS, bool)
        flags[[pii._slot(t) for t in terms]] = True
        sets.append(np.packbits(flags))
    return pii.Finder(*sets)


@pytest.mark.parametrize("text,kinds", [
    ("write to a.b+c@mail.example.net now", {"email"}), ("x_y [at] mail [dot] example [dot] net", {"email"}), ("the tag is v27@latest, @app.route", set()),
    ("call +1 202-555-0188", {"phone"}), ("(415) 555-0171", {"phone"}), ("2025550148", {"phone"}), ("order number 2025550148", set()), ("tel_303-555-0150", {"phone"}), ("Build 4.46.555.0160 broke", set()), ("Order number 94817494452", set()),
    ("SSN 921-59-3099", {"id_number"}), ("passport no. X3322924", {"id_number"}), ("QQ 63 91 51 C", {"id_number"}), ("filed as 978-0-00-1200-72 on 2031-06-16", set()),
    ("at 296 Saltmarsh Ave, Neudorfen", {"address"}), ("PO Box 105, X", {"address"}), ("Kirchstraße 30, 01440 Osterhaven", {"address"}), ("level 72 of Street Runner 3", set()),
    ("by ANNA BERG", {"name"}), ("berg, anna", {"name"}), ("Anna K. Berg-Holm", {"name"}), ("real_anna_berg", {"name"}), ("AnnaBerg88", {"name"}), ("Anna K. came", set()), ("Berg & Holm Ltd", set()), ("", set()), (None, set()),
])
def test_personal_kinds(text, kinds):
    assert {k for *_, k in _finder().mentions(text)} == kinds


def test_sanitised_stays_readable():
    assert _finder().sanitise("I am Anna Berg, a@b.org.") == "I am [name], [email]."
    long = "word " * 50_000 + "a@b.org"
    assert _finder().sanitise(long).endswith("[email]")


def test_personal_edges(spark):
    conv = spark.createDataFrame([("m1", "My name is Anna Berg. a@b.org", "x"), ("m1", "My name is Anna Berg. a@b.org", "x"), ("m2", None, "x"), (None, "a@b.org", "x"), ("m3", "", "x")], "message_id string, text string, src_table string")
    com = spark.createDataFrame([("k1", None, "c@d.org")], "id string, body string, author string")
    got = {tuple(r) for r in pii.found(pii.fields(conv, com)).collect()}
    assert {("conversations", "text", "m1", "email"), ("reddit_comments", "author", "k1", "email")} <= got and all(r[2] in ("m1", "k1") for r in got)
    assert pii.found(pii.fields(conv.limit(0), com.limit(0))).count() == 0


def test_contexts_and_phones_are_learnt(spark):
    """A phrase that the corpus shows before known names reveals new ones; ten digits are a phone number after words like those before others."""
    known = [("anna", "berg"), ("omar", "holm"), ("lena", "varga")]
    rows = [f"mail {g}.{f}@example.org or write" for g, f in known] * 4
    rows += [f"a toast for {g} {f} tonight" for g, f in known] * 3 + ["a toast for Rosa Quist tonight", "so call Rosa Quist now"] * 2
    rows += ["the house is big and the garden is green"] * 60 + ["call +44 20 7946 0573 now"] * 3 + ["order 12345678901 and order 345678901234 came"] * 5
    texts = spark.createDataFrame([("t", "f", str(i), t) for i, t in enumerate(rows)] + [("t", "f", "bare", "call 2025550148 now"), ("t", "f", "order", "order 2025550148 came"), ("t", "f", "n", None)], "src_table string, field string, record_id string, text string")
    got = {(r["record_id"], r["pii_type"]) for r in pii.found(texts).collect()}
    quist = {str(i) for i, t in enumerate(rows) if "Quist" in t}
    assert {(q, "name") for q in quist} <= got and ("bare", "phone") in got and ("order", "phone") not in got
    assert not {r for r, _ in got} & {str(i) for i, t in enumerate(rows) if "house" in t or "order" in t}


def _texts(spark, rows):
    return spark.createDataFrame([("t", "f", str(i), t) for i, t in enumerate(rows)], "src_table string, field string, record_id string, text string")


KNOWN = [("anna", "berg"), ("omar", "holm"), ("lena", "varga")]
KNOWN_SIDES = tuple(zip(*KNOWN))


def test_context_with_a_sign_between_its_words_is_learnt(spark):
    rows = [f"mail {g}.{f}@example.org or write" for g, f in KNOWN] * 4 + [f"a toast - for {g} {f} tonight" for g, f in KNOWN] * 3
    rows += ["a toast - for Rosa Quist tonight", "so call Rosa Quist now"] * 2 + ["the house is big and the garden is green"] * 60
    got = {(r["record_id"], r["pii_type"]) for r in pii.found(_texts(spark, rows)).collect()}
    assert {(str(i), "name") for i, t in enumerate(rows) if "Quist" in t} <= got


def test_contexts_that_cannot_be_learnt_are_not_counted_in_every_text(spark):
    """A phrase before names only now and then is left out as soon as the texts with names show it; what is learnt stays."""
    rows = [f"a toast for {g} {f} tonight, and in the evening some friends went home" for g, f in KNOWN] * 3
    rows += [f"near the {g} {f} sign, near the old house, near the red gate, near the big tree" for g, f in KNOWN]
    known = _finder(*KNOWN_SIDES).lexicon
    assert {(r["context"], r["hits"]) for r in pii._contexts(_texts(spark, rows), "text", known.given, known.family).collect()} == {("toast for", 9)}


def test_asked_contexts_are_found_as_by_reading_everything():
    rng, contexts = random.Random(3), ["toast for", "a a", "name is", "é for"]
    sets = [_finder([c.split()[0] for c in contexts], [c.split()[1] for c in contexts]).lexicon, _finder(contexts, []).lexicon]
    places = pii._Places(sets[0].given, sets[0].family, sets[1].given)
    parts = ["toast", "for", "For", "a", "A", "name", "is", "É", "Anna", "Berg", "x1", "toast_for", "K."]
    held = 0
    for _ in range(20_000):
        text = "".join(rng.choice(parts) + rng.choice([" ", " ", " ", " ", "\n", ", ", " - ", "-", ": \"", "--- ", " — "]) for _ in range(rng.randint(3, 12)))
        want = [x for x in pii._before(text) if x[0] in contexts]
        assert sorted(places.after(text)) == sorted(want), text
        held += len(want)
    assert held > 400


# 2 languages


@pytest.fixture(scope="module")
def model():
    d = pd.read_parquet("/root/testdata/sf0.01/conversations.parquet").drop_duplicates("message_id")
    lab = d.lang.fillna("").str.lower().str.split("[-_]", regex=True).str[0]
    return langid.train(list(d.text.fillna("")), list(lab))


def test_language_held_out(model):
    d = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").dropna(subset=["lang"])
    out = langid.segments(list(d.text), langid.Scorer(model))
    right = [max(s, key=lambda x: x[1])[0] == la for s, la in zip(out, d.lang) if s]
    assert model.accuracy > 0.95 and len(right) > 0.9 * len(d) and np.mean(right) > 0.95


def test_language_edges(model):
    s = langid.Scorer(model)
    mixed = "How do I tell whether the rental car is slow enough for a first try?\nWarum heißt es immer, die Migräne sei zu zuverlässig für den Anfang?"
    out = langid.segments([None, "", "  ", "12345 67", mixed, mixed.split("\n")[0]], s)
    assert [len(x) for x in out[:4]] == [0, 0, 0, 0] and [x[0] for x in out[4]] == ["en", "de"] and [x[0] for x in out[5]] == ["en"]
    empty = langid.train([], [])
    assert langid.segments(["some words here"], langid.Scorer(empty)) in ([[]], [[("en", 15, 0.125)]])


@pytest.mark.parametrize("text", ["Set it to 52 µm – no more, no less.", "Zoë’s copy says ‘draft 55’, mine doesn’t.", "Order number 92717684452 is still open.", "Commit 4f619ab59e touched 4 files in the café § 3.", "Could you draft a short note about the census roll for my team?"])
def test_english_with_odd_signs_is_english(model, text):
    around = "A beginner should touch the league table only after the head coach has stopped."
    assert [x[0] for x in langid.segments([f"{around} {text}"], langid.Scorer(model))[0]] == ["en"]


def test_wrong_labels_do_not_settle_a_sentence():
    rng = random.Random(4)
    own = {"en": "the house of my friend is big", "es": "la casa de mi amigo es muy grande", "pt": "a casa do meu amigo não é grande"}
    texts, labels, weights = [], [], []
    for _ in range(600):
        la = rng.choice(list(own))
        texts.append(own[la] + f" {rng.choice('abcdefgh')}x.")
        labels.append(la if rng.random() < 0.7 else rng.choice(list(own)))
        weights.append(10.0 if labels[-1] == "en" else 1.0)
    model = langid.train(texts, labels, weights)
    out = langid.segments(list(own.values()), langid.Scorer(model))
    assert [s[0][0] for s in out] == list(own)


def test_chats_by_segments_and_latest_label(spark, model):
    en, de = "How do I tell whether the rental car is slow enough for a first try?", "Warum heißt es immer, die Migräne sei zu zuverlässig für den Anfang, und was heißt das für uns?"
    chats = [
        ("a", 1, True, "de", [("user", en), ("bot", f"{de} {de}"), ("tool", en * 9)]),
        ("b", 1, True, "fr", [("user", f"{en} {de} {de}")]), ("b", 2, True, "de", [("user", f"{en} {de} {de}")]),
        ("c", 1, True, None, [("human", en), ("assistant", None)]), ("d", 1, False, None, [("user", en)]), ("e", None, True, "und", [("user", de)]), ("f", 1, True, "EN-us", [("user", en)]), ("g", 1, True, None, None), (None, 1, True, None, [("user", en)]),
    ]
    raw = spark.createDataFrame(chats + chats[:1], "share_id string, fetched_at bigint, fetch_success boolean, conversation_language string, messages array<struct<role string, text string>>").selectExpr("*", "1 as lang")
    assert sorted((r["record_id"], r["lang"]) for r in langid.mislabelled_chats(raw, model).collect()) == [("c", "en"), ("e", "de")]
    assert langid.mislabelled_chats(raw.limit(0), model).count() == 0


# 3 encodings


@pytest.mark.parametrize("misread", ["cp1252", "latin-1", "cp1251", "mac_roman", "iso8859-2", "cp437"])
def test_encoding_round_trip(misread):
    text = "Größe: das Café – naïve façade über Ümläute, jalapeño"
    bad = text.encode().decode(misread, "strict" if misread != "cp1252" else "ignore")
    hit, fixed = encoding.examine(bad)
    assert hit and (fixed == text or misread == "cp1252")


def test_encoding_layers_and_clean():
    twice = "café über".encode().decode("latin-1").encode().decode("latin-1")
    assert encoding.examine(twice) == (True, "café über")
    for t in (None, "", "plain", "l’eau déjà «ça» €5 – Größe", "Это всё ещё хорошо, её нет", "Why does my export show `Ã©` here?"):
        assert encoding.examine(t) == (False, None)
    assert encoding.examine("the caf� was �nice�") == (True, None)
    assert encoding.examine("x" * 100_000 + " cafÃ©")[1].endswith("café")


# 4 defects


def test_defects():
    ends = defects.Endings()
    ends.add(["We go to the big house. It is good. They go to the big house. Fine."] * 20)
    d = lambda q, a, spoken=("en",), got="en": defects.defect(q, a, ends, set(spoken), got)
    q = "Could you draft a short note about the dividend for my team?"
    for a in (None, "", " ​", "N/A", "...", "[no content]"):
        assert d(q, a) == "empty_answer"
    assert d(q, f'You asked: "{q}"') == "copied_question" and d(q, "  ".join(q.upper().split())) == "copied_question"
    assert d(q, "I'm sorry, but I can't help with that request.") == "refusal"
    assert d(q, "I can't see the file itself, but from your description this is what happens. " + "The dividend is paid each year to holders of the stock. " * 3) is None
    assert d(q, "Hay muchos errores comunes en esto, y la prueba siempre está entre ellos.", got="es") == "wrong_language"
    assert d("Please translate this into Spanish: hello there", "Hola, esto es una prueba larga.", got="es") is None
    assert d(q, "Take this. ```python\nx = 1") == "truncated_answer" and d(q, "It is good. We go to the") == "truncated_answer"
    assert d(q, "It is good. We go to the big house.") is None and d(None, "It is good.") is None


def test_copies_by_compression():
    q = "what's the deal with the joint inflammation, seriously"
    assert defects.is_copy(q, f'You asked: "{q}"') and defects.is_copy("Summarise the goalkeeper in 58 words.", 'You asked: "Summarise the goalkeeper in 58 words."')
    assert defects.is_copy(q, " ".join([q] * 40)) and not defects.is_copy(q, q + " It comes from cold weather, and the doctor will tell you more about that when you see her.")
    assert not defects.is_copy("", q) and not defects.is_copy(None, q) and not defects.is_copy("?!", "?!")


def test_cut_list_items_and_prose():
    ends = defects.Endings()
    nouns = ["roux", "layover", "dividend", "rental car", "balance sheet", "egg white"]
    ends.add([f"Note that a slow {a} is not the same thing as a slow {b}.\nAvoid the {b} on busy days; the {a} is more forgiving.\nfine" for a in nouns for b in nouns] * 5)
    whole = "- Avoid the roux on busy days; the layover is more forgiving\n- Note that a slow roux is not the same thing as a slow layover"
    assert not defects.is_truncated(whole, ends) and not defects.is_truncated(whole.replace("slow layover", "slow rental car"), ends)
    assert defects.is_truncated(whole.replace("slow layover", "slow rental"), ends) and defects.is_truncated(whole[: whole.rindex("thing")], ends)
    assert defects.is_truncated("Note that a slow roux is not the same thing as a slow dividend. Avoid the roux on busy days; the", ends)
    assert not defects.is_truncated("Fine.\nname;phone\nAnna Berg;+1 202-555-0188", ends) and not defects.is_truncated("doc check: DNI 00049572-T", ends)
    assert defects.is_truncated("and", ends) and defects.is_truncated("so,", ends)


def test_short_questions_have_the_language_of_most_answers(spark, model):
    en, es = "A beginner should touch the league table only after the head coach has stopped.", "Muchos discuten sobre el aeropuerto, pero casi nadie habla sobre el transbordador."
    rows = [(f"e{i}", 1, "Thanks!", en) for i in range(9)] + [("x", 1, "Thanks!", es), ("y", 1, "¡Gracias!", es), ("z", 1, "?", es), ("n", 1, None, es), ("w", 1, "How do I tell whether the rental car is slow?", es), ("t", 1, "thanks", "It is a (")]
    df = spark.createDataFrame(rows + rows[:3], "conv_id string, turn int, user_text string, assistant_text string").selectExpr("*", "'k' as keys", "1 as short")
    assert {(r["conv_id"], r["defect_type"]) for r in defects.found(df, model).collect()} == {("x", "wrong_language"), ("w", "wrong_language"), ("t", "truncated_answer")}


def test_endings_are_exact(spark, model):
    """Contexts however many keep their own counts, and the joined counts decide as the model held whole does."""
    ends = defects.Endings()
    texts = [f"a{i} b{i}. c{i} d{i} e{i}. end" for i in range(100_000)]
    ends.add(texts)
    assert all(ends.probability(f"z b{i}") > 0.6 for i in range(0, 100_000, 997))
    assert all(ends.probability(f"c{i} d{i}") < 0.35 for i in range(0, 100_000, 997))
    sf = "/root/testdata/sf0.01"
    pairs = table(spark, sf, "semantic_alignment")
    rows = pairs.filter("turn > 0 and conv_id is not null").select("conv_id", "turn", "assistant_text").collect()
    whole = defects.Endings()
    whole.add([r["assistant_text"] for r in pairs.select("assistant_text").filter("assistant_text is not null").collect()])
    got = {(r["conv_id"], r["turn"]): r["defect_type"] for r in defects.found(pairs, model).collect()}
    cut = {(r["conv_id"], int(r["turn"])) for r in rows if not defects.is_empty(r["assistant_text"]) and defects.is_truncated(r["assistant_text"], whole)}
    assert {k for k, v in got.items() if v == "truncated_answer"} <= cut and cut <= set(got)


def test_nothing_found_in_a_partition(spark, model):
    """Batches without a hit end well, as do empty tables."""
    rows = spark.createDataFrame([("k1", 1, "Is it?", "It is good to see the house.", "en", "user", "plain text only, nothing wrong with it at all here")] * 3, "conv_id string, turn int, user_text string, assistant_text string, lang string, role string, text string")
    rows = rows.withColumn("message_id", rows.conv_id)
    for df in (rows, rows.limit(0)):
        assert defects.found(df, model).count() == 0
        assert encoding.found([("t", df, "conv_id", "text")]).count() == 0
        assert langid.mislabelled_messages(df, model).count() == 0


# 5 conversations


def _brute(rows):
    out = set()
    for c, g in pd.DataFrame(rows, columns=["conv_id", "message_id", "parent", "create_time", "turn", "role", "text"]).drop_duplicates("message_id").groupby("conv_id"):
        if g.role.isna().any():
            continue
        if g.parent.notna().any():
            kids, root = {}, g[g.parent.isna()].message_id.tolist()
            if len(root) != 1 or g.parent.dropna().duplicated().any():
                continue
            kids = dict(zip(g.parent, g.message_id))
            order = root
            while order[-1] in kids:
                order.append(kids[order[-1]])
            if len(order) != len(g):
                continue
        else:
            order = g.sort_values(["create_time", "turn", "message_id"]).message_id.tolist()
        m = g.set_index("message_id").loc[order]
        talk = [(r, not (t or "").strip()) for r, t in zip(m.role, m.text) if r in ("user", "assistant")]
        if not any(r == "user" and not b for r, b in talk) or any(r == "user" and not b and (i + 1 == len(talk) or talk[i + 1] == ("assistant", True)) for i, (r, b) in enumerate(talk)):
            continue
        out |= {(c, i, x) for i, x in enumerate(order)}
    return out


def test_conversations_brute_force(spark):
    rng, rows = random.Random(3), []
    for c in range(60):
        n = rng.choice([1, 2, 3, 6, 9, 40])
        linked = rng.random() < 0.7
        for i in range(n):
            parent = f"c{c}_{i - 1}" if linked and i else None
            if linked and rng.random() < 0.02:
                parent = rng.choice([None, "gone", f"c{c}_{rng.randrange(n)}"])
            rows.append((f"c{c}", f"c{c}_{i}", parent, float(rng.choice([i, i, 5])), i, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else ("user", "assistant")[i % 2] if rng.random() > 0.01 else None, rng.choice(["x", "x", "x", "x", " ", None])))
    schema = "conv_id string, message_id string, parent string, create_time double, turn bigint, role string, text string"
    df = spark.createDataFrame(rows + rows[:20], schema).selectExpr("*", "timestamp'2024-01-01' as ingested_at", "1 as position")
    got = [tuple(r) for r in conversations.rebuild(df).select("conv_id", "position", "message_id").collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows)
    assert conversations.rebuild(df.limit(0)).count() == 0


# 7 leakage


def test_leakage_finds_all_near_fingerprints():
    rng = np.random.default_rng(1)
    index = leakage.build({i: " ".join(f"w{rng.integers(300)}" for _ in range(60)) for i in range(20)})
    for windows in index.windows:
        flips = windows.prints.copy()
        for _ in range(windows.radius):
            flips ^= np.uint64(1) << rng.integers(0, 64, len(flips)).astype(np.uint64)
        q, w = leakage.near(windows, flips)
        want = {(i, j) for i in range(len(flips)) for j in np.flatnonzero(np.bitwise_count(flips[i] ^ windows.prints) <= windows.radius)}
        assert set(zip(q.tolist(), w.tolist())) == want and len(want) >= len(flips)


def test_leakage_prints_are_simhashes():
    signs = leakage._Signs(frozenset({"a"}))
    ids = np.array([signs[w] for w in "a b c a d e f g h i a k l m n o p q r s t u v w x y z a b c d e f g h i j k l m n o p q".split()])
    for size in (*leakage.SIZES, 1, 3, 63):
        want = [int("".join("01"[int(x >= 0)] for x in signs.table[ids[i : i + size]].astype(int).sum(axis=0)), 2) for i in range(len(ids) - size + 1)]
        assert leakage.fingerprints(ids, signs, size).tolist() == want


def test_leakage_pieces(spark):
    rng = random.Random(5)
    item = " ".join(f"word{rng.randrange(900)}" for _ in range(60))
    ws = item.split()
    changed = [w if i % 13 else "perhaps" for i, w in enumerate(ws)]
    texts = [item, "A b c. " + " ".join(ws[5:30]) + " end", " ".join(ws[:9]), None, "", "x " * 30_000 + item.upper(), "so " + " ".join(changed), " ".join(ws[:11]) + " and then, much later, " + " ".join(ws[40:52])]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(0, item, "c")], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short")], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leakage.found(docs, bench).collect()} == {(0, 7), (1, 7), (5, 7), (6, 7), (7, 7)}
    assert leakage.found(docs.limit(0), bench).count() == 0 and leakage.found(docs, bench.limit(0)).count() == 0


def test_leakage_brute_force_and_slices(spark):
    """All pairs verified by hand give the same rows, whatever the size of a slice."""
    sf = "/root/testdata/sf0.001"
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = {(r["doc_id"], r["item_id"], round(r["share"], 6)) for r in leakage.found(docs, bench).collect()}
    index = leakage.build(dict(bench.toPandas().dropna(subset=["text"]).drop_duplicates("item_id")[["item_id", "text"]].itertuples(index=False)))
    want = {(r["doc_id"], i, round(s, 6)) for r in docs.collect() if r["text"] for k, i in enumerate(index.ids) if (s := leakage.share(index, k, leakage.words(r["text"]))) >= leakage.SHARE}
    assert want and got == want
    assert got == {(r["doc_id"], r["item_id"], round(r["share"], 6)) for r in leakage.found(docs, bench, size=150).collect()}


# 8 mixing


def test_rake_reaches_targets():
    cells = pd.DataFrame([(s, la, t, n) for s, n in (("a", 1000), ("b", 300), ("c", 40)) for la in "xy" for t in "uv"], columns=["source", "lang", "topic", "tokens"])
    uses = mixing.rake(cells, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 2, "c": 5})
    got = (cells.tokens * uses).groupby(cells.source).sum()
    assert np.allclose(got / got.sum(), [0.5, 0.3, 0.2], atol=1e-6) and (uses <= cells.source.map({"a": 1, "b": 2, "c": 5}) + 1e-9).all()
    assert len(mixing.rake(cells.iloc[:0], {"a": 1.0}, {"a": 1})) == 0


# 9 subjects


def test_subjects_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    stored = subjects.prepared(table(spark, sf, "documents"))
    f = subjects.fit(stored, *(table(spark, sf, t) for t in ("subject_labels", "subject_areas")))
    got = subjects.found(stored, f).toPandas().groupby("doc_id").subject.agg(set)
    labels = pd.read_parquet(f"{sf}/subject_labels.parquet")
    want = labels.assign(s=[subjects._key(x) for x in labels.subject]).groupby("doc_id").s.agg(set)
    hits = sum(len(got.get(d, set()) & s) for d, s in want.items())
    assert hits > 0.8 * sum(map(len, want)) and hits > 0.8 * sum(len(got.get(d, set())) for d in want.index)
    nothing = subjects.prepared(table(spark, sf, "documents").limit(0))
    assert subjects.found(nothing, f).count() == 0
    nobody = subjects.fit(nothing, *(table(spark, sf, t).limit(0) for t in ("subject_labels", "subject_areas")))
    assert subjects.found(stored, nobody).count() == 0


def test_mixtures_by_block_equal_plain_updates():
    rng = np.random.default_rng(2)
    h = rng.random((5, subjects.SLOTS))
    h /= h.sum(axis=1, keepdims=True)
    n = np.array([3, 0, 700, 12, 1, 12, 40])
    c, v = rng.integers(0, subjects.SLOTS, n.sum()), rng.random(n.sum()).astype(np.float32) + 0.1
    total = np.zeros((subjects.SLOTS, 5))
    got, want = subjects.mixtures(h, n, c, v, total=total), []
    sums = np.zeros((subjects.SLOTS, 5))
    for lo, m in zip(np.cumsum(n) - n, n):
        w, hc, x = np.full(5, 0.2), h.T[c[lo : lo + m]], v[lo : lo + m]
        for _ in range(subjects.INNER if m else 0):
            w = w * (hc.T @ (x / (hc @ w)))
            w /= w.sum()
        want.append(w)
        part = hc * w
        np.add.at(sums, c[lo : lo + m], part / part.sum(axis=1, keepdims=True) * x[:, None])
    assert np.allclose(got, want, atol=1e-4) and np.allclose(total, sums, atol=1e-3)


def test_mix_keeps_targets_and_caps(spark):
    rows = [(i, f"some words about the house number {i} " * (1 + i % 3), ("a b", "A_B", "small")[i % 3], ("en", "EN-us", None, "??", "de")[i % 5]) for i in range(900)] + [(9000, None, "a b", "en"), (None, "x", "a b", "en"), (9001, "x", None, "en"), (9002, "x", "other", "en")]
    docs = spark.createDataFrame(rows + rows[:20], "doc_id bigint, text string, source string, lang string").selectExpr("*", "1 as size", "2 as topic")
    targets = spark.createDataFrame([("a b", 0.5, 1), ("small", 0.5, 2), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    stored = mixing.prepared(docs)
    labels, areas = spark.createDataFrame([], "doc_id bigint, subject string"), spark.createDataFrame([("science", "house")], "subject string, description string")
    f = subjects.fit(stored, labels, areas)
    mixed = mixing.mix(stored, targets, f)
    got = {r["source"]: r for r in mixing.report(mixed, targets).collect()}
    assert abs(got["a_b"]["actual_share"] - 0.5) < 0.05 and abs(got["small"]["actual_share"] - 0.5) < 0.05 and got["gone"]["tokens"] == 0
    assert all(r["most_copies"] <= r["max_repeats"] for r in got.values()) and mixed.count() == mixed.select("doc_id").distinct().count()
    assert mixing.mix(mixing.prepared(docs.limit(0)), targets, f).count() == 0


def test_queries_are_registered():
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 7, 9)} <= set(queries.QUERIES) and "p8_mix" in queries.QUERIES
