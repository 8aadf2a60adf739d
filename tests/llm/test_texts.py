import base64
import random

import numpy as np
import pytest

from loomfit.llm import mail, packing, tokens, topics

TRICKY = ["", None, " ", "a", "don't  stop\n\n now<|endoftext|> ÄÖ 漢字🙂 x1y22,,,; '" * 30, "x" * 3000, "1" * 500 + "ab " * 900, "\n \n\t a" * 400]


def test_encoding_and_round_trip(spark):
    df = spark.createDataFrame([(k, t, [1]) for k, t in enumerate(TRICKY)], "doc_id bigint, text string, ids array<int>")
    enc = tokens.encoder(open(tokens.RANKS, "rb").read())
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_texts(df).collect()}
    assert got == {k: enc.encode_ordinary(t or "") for k, t in enumerate(TRICKY)}
    back = {r["doc_id"]: r["text"] for r in tokens.decode_ids(tokens.encode_texts(df)).collect()}
    assert back == {k: t or "" for k, t in enumerate(TRICKY)}
    assert tokens.encode_texts(df.limit(0)).count() == 0


def test_long_texts_are_cut_where_the_pattern_cuts():
    enc = tokens.encoder(open(tokens.RANKS, "rb").read())
    rng = random.Random(6)
    for _ in range(60):
        text = "".join(rng.choice(["a", "Zz", " ", "  ", "\n", "7", "'s", "'", ",", "é", "漢", " ", "\r\n", "🙂"]) for _ in range(300))
        for long in (1, 5, 40):
            pieces = list(tokens.parts(text, long))
            assert "".join(pieces) == text and [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_hilbert_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        key = packing.hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_packing(spark):
    rng = random.Random(7)
    sizes = [rng.randrange(0, 60) for _ in range(500)] + [100, 101, 250, 300, 0]
    df = spark.createDataFrame([(k, n, rng.randrange(1000)) for k, n in enumerate(sizes)], "doc_id bigint, size bigint, place bigint")
    got = packing.pack(df, capacity=100).collect()
    room, by = {}, {}
    for r in got:
        room[r["container"]] = room.get(r["container"], 0) + r["size"]
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["size"]))
    assert max(room.values()) <= 100 and sum(room.values()) / len(room) > 93
    for k, n in enumerate(sizes):
        p = sorted(by[k])
        assert sum(x[2] for x in p) == n and len(p) == max(1, -(-n // 100)) and [x[1] for x in p] == [100 * j for j in range(len(p))]
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, capacity=0)


def test_containers_hold_neighbours_on_the_curve_and_are_full(spark):
    rng = np.random.default_rng(8)
    n = 6_000
    sizes = np.minimum(rng.lognormal(6.7, 0.8, n), 9_000).astype(int)
    df = spark.createDataFrame([(k, int(s), int(p)) for k, (s, p) in enumerate(zip(sizes, rng.permutation(n)))], "doc_id bigint, size bigint, place bigint")
    rank = {r["doc_id"]: r["place"] for r in df.collect()}
    at, used = {}, {}
    for r in packing.pack(df).collect():
        at.setdefault(r["container"], []).append(rank[r["doc_id"]])
        used[r["container"]] = used.get(r["container"], 0) + r["size"]
    far = sorted(max(x) - min(x) for x in at.values() if len(x) > 1)
    assert max(used.values()) <= 4_096 and sum(used.values()) / len(used) / 4_096 > 0.97
    assert far[len(far) // 2] < 0.01 * n


HEAD = "From x@y.example Mon\nReceived: from a\n\tby b\nSubject: re: court\nMIME-Version: 1.0\n"


def test_own_words():
    plain = HEAD + "Content-Type: text/plain\n\nMy own words. Second one!\n\nOn Mon, 1 Jan 2025, A wrote:\n> quoted text\n> more\n\nBelow the quote.\n-- \nName\nCourt Clerk"
    assert [s.strip() for s in mail.sentences(mail.own_text(plain))] == ["My own words.", "Second one!", "Below the quote."]
    b64 = HEAD + "Content-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode("<html><head><style>p{}</style></head><p>Grüße &amp; mehr.<br>Zwei.</p><blockquote>quoted</blockquote></html>".encode()).decode()
    assert mail.own_text(b64).split() == ["Grüße", "&", "mehr.", "Zwei."]
    cut = HEAD + 'Content-Type: multipart/mixed; boundary="B"\n\npreamble\n--B\nContent-Type: text/plain\nContent-Transfer-Encoding: quoted-printable\n\nCaf=C3=A9 an=\nd tea.\n--B\nContent-Type: application/octet-stream\nContent-Disposition: attachment\n\nAAAA'
    assert mail.own_text(cut).strip() == "Café and tea."
    assert mail.own_text(HEAD + "\nNew.\n-----Original Message-----\nFrom: a\nold") == "New.\n"
    for t in (None, "", "\n", "x", HEAD, "Content-Type: multipart/mixed; boundary=\n\n--", "a" * 100_000, HEAD + "Content-Transfer-Encoding: base64\n\n!!!"):
        assert isinstance(mail.own_text(t), str)
    assert mail.mended("donnÃ©es Ã") == "données Ã"


def test_signatures_and_disclaimers_are_what_repeats(spark):
    rng = random.Random(3)
    legal, polite = ["All liability is excluded.", "Ask before you copy the contract."], ["That is all.", "More on friday."]
    docs = []
    for k in range(60):
        own = [f"We saw item{rng.randrange(10**6)} and item{rng.randrange(10**6)} there.", rng.choice(polite)]
        end = "\n\nKind wishes\nA. Name\nLegal office" if k % 2 else ""
        docs.append((k, " ".join(own) + f"\n\nThen item{rng.randrange(10**6)} came. " + rng.choice(polite) + end + "\n\n" + "\n".join(rng.sample(legal, 2))))
    docs += [(100, None), (101, ""), (102, "Kind wishes to all of you, and thanks for the long letter about everything.")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("doc_id", "text", "-1 AS claim")
    rows = topics.parsed(df, "doc_id", "text", "claim")
    openers, disclaimers = topics.repeated(rows, len(docs))
    assert set(openers) == {topics.term("kind wishes"), topics.term("all liability is excluded")}  # both open what ends a message
    assert set(disclaimers) >= {topics.mark(x) for x in legal} and not set(disclaimers) & {topics.mark(x) for x in polite}
    for r in topics.cleaned(rows, openers, disclaimers).collect():
        words = [w for s in mail.sentences(dict(docs)[r["doc_id"]] or "") for w in topics.terms_of(s)]
        assert len(r["ends"]) == (4 if r["doc_id"] < 60 else 1 if r["doc_id"] == 102 else 0) and len(r["words"]) == (r["ends"][-1] if r["ends"] else 0)
        assert set(r["words"]) <= set(words)
    assert [len(v) for v in topics.repeated(rows.limit(0), 0)] == [0, 0]


def test_subjects(spark):
    rng = random.Random(9)
    words = {"law": ["judge", "verdict", "plaintiff", "statute"], "music": ["cello", "melody", "octave", "tempo"]}
    talk = ["nothing else from my side", "one more thing before I forget", "can we talk on friday", "thanks for the quick answer"]
    about = "we looked at the {} and the {} again this week".format
    docs, truth = [], {}
    for k in range(240):
        s = ["law", "music", None][k % 3]
        own = [about(*rng.sample(words[s], 2)) for _ in range(4)] if s else []
        docs.append((k, ". ".join(own + [rng.choice(talk) for _ in range(2 if s else 6)]) + ".", "en", 1))
        truth[k] = s
    docs += [(900, None, None, 1), (901, "", "en", 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, words int")
    labels = spark.createDataFrame([(k, truth[k].upper(), "r") for k in range(40) if truth[k]] + [(1, "law", "r"), (2, None, "r"), (None, "law", "r"), (3, "nonsense", "r")], "doc_id bigint, subject string, reader string")
    subjects = spark.createDataFrame([("law", ""), ("music", "")], "subject string, description string")
    got = {(r["doc_id"], r["subject"]) for r in topics.subjects_of(df, subjects, labels).collect()}
    want = {(k, s) for k, s in truth.items() if s and k >= 40}
    assert len(want & got) > 0.95 * len(want) and len({g for g in got if g[0] >= 40} - want) < 0.05 * len(want)
    assert topics.subjects_of(df, subjects, labels.limit(0)).count() == 0
    assert topics.subjects_of(df.limit(0), subjects, labels).count() == 0
