import random

import numpy as np
import pytest

from gristmill.llm import spam
from gristmill.llm import wordclass as wc

NAMES = ["krafolmide", "Zentrupan-β2", "TRKX12-molin", "glistaphages", "vorunemis", "pelixane", "dorsitin", "quemolane"]
PROSE = {
    "en": ["We measured {a} in the second group and found that {b} was lower than in controls.", "The role of {a} in this process is still poorly understood.", "Although {a} was detected early, no link with {b} could be shown.", "Samples from {n} patients were stained for {a} and counted twice.", "Is {a} a cause or a consequence of {b}?"],
    "de": ["Die Teilnehmer erhielten {a} oder ein Scheinmittel, ohne dies zu wissen.", "Nach {n} Wochen war der Anteil von {a} deutlich höher als erwartet.", "Frühere Arbeiten hatten {a} meist nicht beachtet.", "Wir zeigen, dass {a} ohne {b} nicht in die Zellen gelangt."],
    "fr": ["Il est possible que {a} ait été confondu avec {b}.", "Les échantillons ont été conservés au froid pendant {n} jours.", "La dose de {a} fut doublée au bout de {n} semaines."],
    "ru": ["Все образцы хранились в темноте при низкой температуре.", "Мы показали, что {a} не действует без {b}.", "В работе изучено влияние {a} на {b} в {n} образцах.", "Через {n} недель уровень {a} оказался выше ожидаемого."],
}
WORDS = ["cheap", "buy", "discount", "sale", "online", "order now", "best price", "review", "free shipping", "bulk"]


def page(rng, lang, n=8):
    return " ".join(rng.choice(PROSE[lang]).format(a=rng.choice(NAMES), b=rng.choice(NAMES), n=rng.randrange(2, 90)) for _ in range(n))


def junk(rng, kind, n=40):
    w = lambda: rng.choice(WORDS)
    name = rng.choice(NAMES)
    if kind == "keywords":
        return rng.choice([" ", ", ", " | ", "; "]).join(f"{w()} {name}" for _ in range(n))
    if kind == "sentences":
        return " ".join(f"{w().capitalize()} {name} {w()}{rng.choice(['.', '!', '?', '!!!'])}" for _ in range(n))
    if kind == "links":
        return "\n".join(f"{w()} {rng.choice(NAMES)} - https://{rng.choice(NAMES).lower()}-shop.example/a{rng.randrange(99)}/b.html" for _ in range(n))
    if kind == "tags":
        return " ".join(f"#{rng.choice(NAMES).lower()} #{w().replace(' ', '')}" for _ in range(n))
    return "\n".join(f"{rng.choice(NAMES)} {rng.randrange(20, 400)}mg x{rng.randrange(10, 90)} {rng.randrange(3, 99)}.{rng.randrange(10, 99)} EUR" for _ in range(n))


KINDS = ["keywords", "sentences", "links", "tags", "products"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng, rows = random.Random(9), []
    for k in range(400):
        lang = rng.choice(list(PROSE))
        rows.append((len(rows), page(rng, lang, rng.randrange(2, 20)), 0))
    for k in range(60):  # articles with a shorter list at their end
        rows.append((len(rows), page(rng, "en", 14) + "\n" + junk(rng, rng.choice(["links", "products"]), 4), 0))
    for k in range(100):
        rows.append((len(rows), junk(rng, KINDS[k % 5], 40), 1))
    for k in range(40):  # a sentence before the junk
        rows.append((len(rows), page(rng, rng.choice(list(PROSE)), 1) + "\n" + junk(rng, KINDS[k % 5], 50), 1))
    return spark.createDataFrame(rows, "doc_id bigint, text string, spam int").repartition(4), {r[0]: r[2] for r in rows}


def test_pages_are_told_apart(labelled):
    df, truth = labelled
    found = {r.doc_id for r in spam.find_spam(df).collect()}
    true = {i for i, s in truth.items() if s}
    assert len(found & true) >= 0.97 * len(true)
    assert len(found - true) <= 0.02 * len(truth)


def test_edge_texts(spark, labelled):
    df, _ = labelled
    odd = [(10_001, None), (10_002, ""), (10_003, " \t\n"), (10_004, "Effects of krafolmide on sleep latency"), (10_005, "."), (10_006, "word " * 400_000), (10_007, "日本語の文章です。" * 20), (None, "x")]
    extra = spark.createDataFrame(odd, "doc_id bigint, text string")
    both = df.select("doc_id", "text").unionByName(extra).unionByName(extra).selectExpr("*", "1 as sym", "2 as chars", "3 as codes", "4 as counts", "5 as id")
    shares = both.transform(spam.score_spam).where("doc_id > 10000 or doc_id is null").collect()
    assert len(shares) == 2 * len(odd)
    by = {r.doc_id: r.spam_share for r in shares}
    assert all(by[i] == 0 for i in (10_001, 10_002, 10_003, 10_004, 10_005)) and by[10_006] > 0.9
    assert spam.find_spam(df.limit(0)).count() == 0


def test_symbols_follow_rows():
    texts = ["The dog, the dog.", "", "Ab-cd 12.5mg https://x.example/a Über ДОМ", "the"]
    raw = [t.encode() for t in texts]
    rows = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    sym, chars, first = wc.symbols(np.frombuffer(b"".join(raw), np.uint8), rows)
    alone = [wc.symbols(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0].tolist() for b in raw]
    assert [sym[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == alone
    assert chars.sum() == sum(len(t.replace(" ", "")) for t in texts)
    the = wc._WORD0 + wc.WORDS.index("the")
    assert alone[0][0] == the and alone[0][3] == the and alone[0][1] != alone[0][4] >= wc._REP0


def test_bits_are_a_distribution():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, wc.SYMBOLS**3, 5000))
    table = wc.bits(codes, rng.integers(1, 50, len(codes)))
    some = rng.integers(0, wc.SYMBOLS**2, 20)
    for k in [*some, *(codes[:20] // wc.SYMBOLS)]:
        p = 2.0 ** -(table[k * wc.SYMBOLS : (k + 1) * wc.SYMBOLS] / 8.0)
        assert 0.9 < p.sum() < 1.1
