import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.llm import abuse, leakage, near_duplicates, packing, sentences, shared_spans, split_oversized
from echoloom.runtime import cut

WORDS = "the a river mill lantern storm cellar garden winter letter paper iron old quiet north runs holds keeps finds under over beside".split()


def prose(rng, n):
    out = []
    while n > 0:
        k = min(n, rng.randrange(4, 12))
        out.append(" ".join(rng.choice(WORDS) for _ in range(k)).capitalize() + ".")
        n -= k
    return " ".join(out)


# --- p1


@pytest.mark.parametrize("unit,limit,overlap", [("token", 20, 4), ("char", 60, 10), ("char", 10, 0)])
def test_pieces_cover_and_overlap(unit, limit, overlap):
    rng = random.Random(2)
    for text in [prose(rng, 150), "x" * 200, "水" * 95, " a " * 80, "one\n\ntwo three. " * 12, "", "word"]:
        pieces = split_oversized.split_text(text, unit, limit, overlap)
        assert pieces[0][0] in (0, len(text) - len(text.lstrip())) and pieces[-1][1] == len(text)
        for (s, e, n), nxt in zip(pieces, pieces[1:] + [None]):
            measure = len(text[s:e].split()) if unit == "token" else e - s
            assert measure == n <= limit
            if nxt:
                common = text[nxt[0] : e]
                assert (len(common.split()) if unit == "token" else len(common)) == overlap


def test_cuts_prefer_natural_boundaries():
    text = "aa bb cc dd. " * 3 + "\n\n" + "ee ff gg hh. " * 3
    assert text[split_oversized.split_text(text, "token", 14, 0)[0][1] :].startswith("ee")


def test_split_frame_edge_cases(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, None, "x"), (3, "", "x"), (None, "a b", "x")], "k int, text string, piece_no string")
    got = split_oversized.split_oversized(df, ["k"], "text", "token", 4, 1)
    rows = sorted((r["k"] or 0, r["piece_no"], r["piece_size"]) for r in got.collect())
    assert [r[:2] for r in rows] == [(0, 0), (1, 0), (1, 1), (3, 0)] and all(r[2] <= 4 for r in rows)
    assert split_oversized.split_oversized(df.limit(0), ["k"], "text", "token", 4, 1).count() == 0


# --- p4

CASES = [
    ("Mr. Lental Returns", ["Mr. Lental Returns"]),
    ("He met Dr. Holfer at 5.30 p.m. The end came.", ["He met Dr. Holfer at 5.30 p.m.", "The end came."]),
    ("It was near the canal… until they left. Then rain.", ["It was near the canal… until they left.", "Then rain."]),
    ("\"Stop there!\" asked Holwick quietly. He ran.", ["\"Stop there!\" asked Holwick quietly.", "He ran."]),
    ("„Halt!“, sagte Drital. Er ging mit Hrn. Darpa z. B. am 7. Mai.", ["„Halt!“, sagte Drital.", "Er ging mit Hrn. Darpa z. B. am 7. Mai."]),
    ("One here.\nTwo there.\n \nHeading\n\n***\n\nThree", ["One here.", "Two there.", "Heading", "Three"]),
    ("— Город пуст! — спросил Ринов. Снег.", ["— Город пуст! — спросил Ринов.", "Снег."]),
    ("「嵐だ！」とサリンは言った。次の文。", ["「嵐だ！」とサリンは言った。", "次の文。"]),
    ("“铁梯在城边……”棠筠低声说。学徒走了。", ["“铁梯在城边……”棠筠低声说。", "学徒走了。"]),
    ("โคมไฟลืม สวนนับ 12,684 บาท เรือเก่า", ["โคมไฟลืม", "สวนนับ 12,684 บาท", "เรือเก่า"]),
    ("यह एक है। दो बाद? हाँ", ["यह एक है।", "दो बाद?", "हाँ"]),
    ("Πού είναι; Εδώ.", ["Πού είναι;", "Εδώ."]),
    ("1. First item here.\n\n2) Second item", ["1. First item here.", "2) Second item"]),
    ("The file notes_34.txt is gone. Frost.Yortal bewachte es.", ["The file notes_34.txt is gone.", "Frost.", "Yortal bewachte es."]),
    ("It cost 13.65. “After that,” said Zan, “we left.”", ["It cost 13.65.", "“After that,” said Zan, “we left.”"]),
    ("“The end came!” Virowsor said. A tail.", ["“The end came!” Virowsor said.", "A tail."]),
    ("«كالعادة نسي!» قال توميفا. الخباز عد.", ["«كالعادة نسي!» قال توميفا.", "الخباز عد."]),
    ("Es war lang. »Die kam!«, sagte Rufa. Ende.", ["Es war lang.", "»Die kam!«, sagte Rufa.", "Ende."]),
    ("The no. of cats rose. I said no. They left. We said no. Then he came. It was no use.", ["The no. of cats rose.", "I said no.", "They left.", "We said no.", "Then he came.", "It was no use."]),
    ("“Go away!” Anna muttered quietly. He ran.", ["“Go away!” Anna muttered quietly.", "He ran."]),
    ("“Go away!” The door closed. Behind the door she waited.", ["“Go away!”", "The door closed.", "Behind the door she waited."]),
    ("“" + "It rained. " * 80 + "It stopped!” said Anna. He ran.", ["“" + "It rained. " * 80 + "It stopped!” said Anna.", "He ran."]),
    ("He spoke to J. R. Tolan. She met J. Her friend stayed with her.", ["He spoke to J. R. Tolan.", "She met J.", "Her friend stayed with her."]),
    ("“It broke. “It held!” said Zan. He ran.", ["“It broke.", "“It held!” said Zan.", "He ran."]),
    ("", []),
    (" \n ", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.sentences(text)] == want


def test_sentences_take_linear_time():
    import time

    took = []
    for n in (200, 1600):
        text = "".join(f"They met Dr. Name{i} no. {i} at approx. noon. Otherword{i} went on, etc. Then it was over. " for i in range(n))
        began = time.process_time()
        assert len(sentences.sentences(text)) >= 2 * n
        took.append(time.process_time() - began)
    assert took[1] < 8 * 4 * took[0]


def test_collection_tells_what_a_document_does_not(spark):
    rows = [(i, f"He came bzg. early on day {i} and saw the house. They saw the bzg. tree, and so on.") for i in range(6)]
    df = spark.createDataFrame([*rows, (9, "We met bzg. Alder there. It rained bzg. They left.")], "k int, text string")
    known = {r["w"]: (r["short"], r["ordinary"]) for r in sentences.collection_words(df.select(F.col("text").alias("t"))).collect()}
    assert known["bzg"][0] and not known["bzg"][1]
    got = [(r["sent_start"], r["sent_end"]) for r in sentences.split_sentences(df, "k", "text").where("id = 9").orderBy("sent_start").collect()]
    text = "We met bzg. Alder there. It rained bzg. They left."
    assert [text[a:b] for a, b in got][0] == "We met bzg. Alder there."


def test_a_large_vocabulary_changes_nothing(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["He came bzg. early. ", "“Go!” Anna said. ", "It rained bzg. They left. ", "We saw J. R. Tolan. ", "So l’apprenti left no. 4. The end. "]) for _ in range(30))) for i in range(12)]
    df = spark.createDataFrame(rows, "k int, text string")
    one = sorted(map(tuple, sentences.split_sentences(df, "k", "text").collect()))
    monkeypatch.setattr(sentences, "BROADCAST_WORDS", 0)
    assert sorted(map(tuple, sentences.split_sentences(df, "k", "text").collect())) == one


def test_sentence_frame(spark):
    df = spark.createDataFrame([(1, "One. Two.", 5), (1, "One. Two.", 6), (2, None, 1), (3, "", 1)], "k int, text string, sentence_index int")
    assert sorted(map(tuple, sentences.split_sentences(df, "k", "text").collect())) == [(1, 0, 0, 4), (1, 1, 5, 9)]
    assert sentences.split_sentences(df.limit(0), "k", "text").count() == 0


# --- p5


def test_shared_runs_against_brute_force(spark):
    rng = random.Random(4)
    base = prose(rng, 120)
    texts = [prose(rng, 30) + base[100:100 + n] + prose(rng, 30) for n in (199, 200, 260, 420)] + [base, "ab" * 300, "b" + "ab" * 140, prose(rng, 3)]
    frame = spark.createDataFrame(list(enumerate(texts)), "cid bigint, text string")
    got = {(r["a"], r["b"]) for r in shared_spans.shared_runs(frame, 200).collect()}
    grams = [{t[i : i + 200] for i in range(len(t) - 199)} for t in texts]
    assert got == {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if grams[i] & grams[j]}
    a, b = shared_spans.common_stretches(texts[2], base, 200)
    assert [texts[2][x["s"] : x["e"]] for x in a] == [base[x["s"] : x["e"]] for x in b] and len(a) == 1


def test_classes_edge_cases(spark):
    r = spark.createDataFrame([("draft", 1, None, "x" * 300), ("draft", 1, None, "x" * 300), ("draft", 2, None, "x" * 300), ("span", 3, 1, None), ("span", None, 1, "y")], "kind string, id bigint, owner bigint, text string")
    members, texts = shared_spans.classes(r)
    assert members.count() == 2 and texts.count() == 1
    assert shared_spans.shared_runs(shared_spans.classes(r.limit(0))[1], 200).count() == 0


# --- p6


def test_trie_join_is_exact():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (40, 2), dtype=np.uint64)
    sk = np.concatenate([base, base ^ (rng.integers(0, 2**63, (40, 2), dtype=np.uint64) & rng.integers(0, 2**63, (40, 2), dtype=np.uint64) & rng.integers(0, 2**63, (40, 2), dtype=np.uint64)), base[:5]])
    roots = rng.integers(0, 3, len(sk)).astype(np.uint64)
    for leaf in (1, 64):
        got = {tuple(sorted(p)) for i, j in near_duplicates.trie_pairs(roots, sk, 34, leaf) for p in zip(i.tolist(), j.tolist())}
        ham = np.bitwise_count(sk[:, None] ^ sk[None]).sum(2)
        want = {(i, j) for i in range(len(sk)) for j in range(i + 1, len(sk)) if roots[i] == roots[j] and ham[i, j] <= 34}
        assert got == want


def test_near_duplicates(spark):
    rng = random.Random(9)
    base = [prose(rng, 200) for _ in range(6)]
    texts = base + [b.replace("river", "bridge", 2) for b in base] + [base[0].upper(), base[0] + "!", "short one", "short one", "", "  ", None]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "again")], "k bigint, text string, id string")
    links, members = near_duplicates.near_duplicates(df, "k", "text")
    links, members = cut(links), cut(members)
    cid = {r["id"]: r["cid"] for r in members.collect()}
    linked = {frozenset((r["a"], r["b"])) for r in links.collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for t in texts for w in [near_duplicates.WORD.findall((t or "").lower())]]
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            if sets[i] and sets[j]:
                sim = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                assert (sim >= 0.72) == (cid[i] == cid[j] or frozenset((cid[i], cid[j])) in linked), (i, j, sim)
    assert set(cid) == {i for i, s in enumerate(sets) if s}
    assert near_duplicates.near_duplicates(df.limit(0), "k", "text")[0].count() == 0


def test_crowded_roots_are_split(spark):
    rng = random.Random(3)
    base = prose(rng, 300)
    texts = [base.replace("the", f"w{i}", 1) for i in range(40)]
    sets = cut(near_duplicates.sketch_sets(spark.createDataFrame(list(enumerate(texts)), "k bigint, text string"), "k", "text", 5))
    assert near_duplicates.near_pairs(sets, 0.72, block_rows=8).count() == 40 * 39 // 2


# --- p7


def test_packing(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(200)] + ["", None, "word " * 1000, "word " * 64]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 1)], "k bigint, text string, container int")
    rows = packing.pack(df, "k", "text", 128).collect()
    enc = packing.encoder(packing.TOKENIZERS, packing.VOCABULARY)
    size = {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts) if t is not None}
    used: dict = {}
    parts: dict = {}
    for r in rows:
        used[r["container"]] = used.get(r["container"], 0) + r["n_tokens"]
        parts.setdefault(r["id"], []).append((r["token_start"], r["n_tokens"]))
    assert max(used.values()) <= 128 and set(parts) == set(size)
    for i, p in parts.items():
        assert sum(n for _, n in p) == size[i] and (len(p) == 1 or size[i] > 128)
        assert sorted(s for s, _ in p) == [128 * k for k in range(len(p))]
    assert sum(size.values()) / (128 * len(used)) > 0.95
    assert packing.pack(df.limit(0), "k", "text", 128).count() == 0


def test_containers_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 16)
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(1, 40)) for _ in range(120)] + ["the same again"] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, text string")
    one, two = (sorted(map(tuple, packing.pack(x, "k", "text", 64).collect())) for x in (df.repartition(1), df.repartition(7, "text")))
    assert one == two
    first, parts = packing.stretches({3: 10, 5: 5, 6: 40, 9: 1})
    assert first[[3, 5, 6, 9]].tolist() == [3, 3, 6, 9] and parts[[3, 5, 6, 9]].tolist() == [1, 1, 3, 1]


def test_hilbert_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_key(cells, 3)
    path = cells[np.argsort(key)]
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# --- p8

ITEM = "Rinesk measured a damp letter with Rowlen along the gravel path, although Corpa wrapped the census book. Two days later, Ferga dragged Botuos, Maros with Paesk near the old mill."


def cues(text, k=4, noise=False):
    w = text.split()
    out = []
    for n, i in enumerate(range(0, len(w), k), 1):
        out.append(f"{n}\n00:00:{n:02d},000 --> 00:00:{n:02d},900\n" + " ".join(w[i : i + k]))
        if noise and n % 3 == 0:
            out.append(f"{n}\n00:00:{n:02d},950 --> 00:00:{n:02d},990\n[door creaks]")
    return "\n\n".join(out)


def test_leaks(spark):
    rng = random.Random(8)
    other = [prose(rng, 300) for _ in range(4)]
    damaged = ITEM.replace("l", "1", 3).replace("o", "0", 2).upper()
    docs_ = [cues(other[0] + " " + ITEM + " " + other[1]), cues(other[1] + " " + ITEM + " " + other[2], noise=True), cues(damaged), other[2] + " " + " ".join(ITEM.split()[:5]), other[3], "", None, ITEM.encode().decode("latin-1")]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs_)], "k bigint, text string, share string")
    items = spark.createDataFrame([(5, ITEM), (6, None), (7, ""), (5, ITEM), *[(20 + i, prose(rng, 60)) for i in range(5)]], "i bigint, t string")
    got = {(r["doc"], r["item"]) for r in leakage.leaked(df, items, "k", "text", "i", "t").collect()}
    assert {d for d, i in got if i == 5} == {0, 1, 2, 7}
    assert leakage.leaked(df.limit(0), items, "k", "text", "i", "t").count() == 0
    assert leakage.leaked(df, items.limit(0), "k", "text", "i", "t").count() == 0


def test_groups_of_items_change_nothing(spark, monkeypatch):
    rng = random.Random(10)
    texts = [prose(rng, 50) for _ in range(30)]
    docs_ = spark.createDataFrame([(k, prose(rng, 40) + " " + t + " " + prose(rng, 60)) for k, t in enumerate(texts)] + [(99, texts[3][: len(texts[3]) // 2])], "k bigint, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string")
    one = sorted(map(tuple, leakage.leaked(docs_, items, "k", "text", "i", "t").collect()))
    monkeypatch.setattr(leakage, "INDEX_ITEMS", 7)
    assert sorted(map(tuple, leakage.leaked(docs_, items, "k", "text", "i", "t").collect())) == one and len(one) >= 30


def test_bounds_drop_no_item():
    rng = random.Random(11)
    index = leakage.ItemIndex([(i, prose(rng, rng.randrange(20, 90))) for i in range(70)])
    table_ = np.zeros((len(index.term), len(index.ids)))
    for k in range(len(index.term)):
        a, b = index.postings.begin[k : k + 2]
        table_[k, index.postings.place[a:b]] = index.postings.value[a:b]
    assert np.allclose(index.term_max, table_.max(1)) and (index.need <= leakage.LEAST_SCORE * table_.sum(0) + 1e-9).all() and (index.need > 0).all()
    for _ in range(40):
        terms = np.unique(np.array(rng.sample(range(len(index.term)), min(12, len(index.term)))))
        assert index.search(terms).tolist() == np.flatnonzero(table_[terms].sum(0) >= index.need).tolist()


def test_every_half_of_an_item_is_found():
    rng = random.Random(13)
    items = [(i, prose(rng, rng.randrange(24, 110))) for i in range(60)]
    index = leakage.ItemIndex(items)
    for i, t in items:
        w = t.split()
        h = -(-len(w) // 2) + 1
        for a in (0, (len(w) - h) // 2, len(w) - h):
            text = prose(rng, 50) + " " + " ".join(w[a : a + h]) + " " + prose(rng, 50)
            assert i in {index.ids[j] for _, j, share in leakage.scan([text], index)}


def test_leak_with_cues_put_in_between():
    rng = random.Random(9)
    w = ITEM.split()
    third = -(-len(w) // 3)
    index = leakage.ItemIndex([(5, ITEM), *[(20 + i, prose(rng, 60)) for i in range(5)]])
    apart = "\n\n".join(cues(x) for k in range(0, len(w), third) for x in (" ".join(w[k : k + third]), prose(rng, 120)))
    tagged = " ".join(f'<font face="{"serif " * 30}">{x}' for x in w)
    quoted = " ".join(w[:third]) + " " + prose(rng, 120) + " " + " ".join(w[:third])
    assert [(no, share) for no, j, share in leakage.scan([apart, tagged, quoted], index) if index.ids[j] == 5] == [(0, 1.0), (1, 1.0)]


# --- p9


def test_folding():
    assert abuse.cue_words("1\n00:00:01,000 --> 00:00:02,000\nYou 1d10t!!\n\n2\n00:00:03,000 --> 00:00:04,000\nHello there") == [["you", "ldlot"], ["helo", "there"]]
    assert abuse.cue_words("w o r t h l e s s  thing")[0] == ["worthles", "thlng"]
    assert abuse.cue_words("fіlthy")[0] == abuse.cue_words("filthy")[0]  # the first has a Cyrillic letter
    assert abuse.cue_words("") == []


def test_machine_finds_witnesses(spark):
    rng = random.Random(6)
    groups, bad, good = ["alphas", "betas", "gammas", "deltas"], "are vermin and must go", "won the cup again today"
    texts, y = [], []
    for i in range(400):
        lines = [prose(rng, 8) for _ in range(5)]
        hateful = i % 4 == 0
        lines.insert(rng.randrange(5), f"The {rng.choice(groups)} {bad if hateful else good}" if i % 2 == 0 else f"Mice {bad.replace('must go', 'eat wheat')}")
        texts.append("\n\n".join(lines))
        y.append((0.0, float(hateful), 0.0))
    m = abuse.train(texts, np.array(y))
    t = abuse.Terms()
    score = lambda s: float(m.score(*abuse.features(abuse.cue_words(s), t)).max(0)[1])
    assert score(f"The betas {bad}") > 0 > max(score(f"The betas {good}"), score(prose(rng, 9)))


def test_abuse_frame(spark):
    docs_ = spark.createDataFrame([(1, "a", "hello there"), (1, "a", "hello there"), (2, None, None), (3, "b", "")], "doc_id bigint, source string, text string")
    labels = spark.createDataFrame([(1, "r", "ok"), (1, "s", None), (9, "r", "abusive")], "doc_id bigint, reviewer string, verdict string")
    for lab in (labels, labels.limit(0)):
        got = {r["doc_id"]: r for r in abuse.score_documents(docs_, lab).collect()}
        assert set(got) == {1, 2, 3} and got[2]["abusive"] == 0.0 and 0 <= got[1]["abusive"] <= 1
    assert abuse.score_documents(docs_.limit(0), labels).count() == 0
