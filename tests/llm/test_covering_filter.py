from gristmill.llm import covering as cv

# Pairs at exactly 0.6 that collide in a table, but differ in 47 and 48 of the sketch's 84 places by three bits.
PAIRS = [
    ("xewnmqcgfrvtwnghxqsncmfminekwjlvxhcczxcwilrcsxnvhrsyquyoiqyzeh", "hxqsncmfminekwjlvxhcczxcwilrcsxnvhrsyquyoiqyzehpccqmdhtusynfnw"),
    ("wnstzonbtrkyrepxmnxqzlatrsgmmonmxtdcaqmflccredwqcwqpsblfcgrztl", "xmnxqzlatrsgmmonmxtdcaqmflccredwqcwqpsblfcgrztlmnfrioobwtkwrul"),
]


def test_colliding_pairs_are_compared(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(t for p in PAIRS for t in p)], "id bigint, claim string")
    got = {(r.a, r.b, r.similarity) for r in cv.near_duplicates(df)[0].collect()}
    assert got == {(0, 1, 0.6), (2, 3, 0.6)}
