import random

from gristmill.plans.queries import QUERIES


def test_long_texts_alike_from_half_on_are_found(spark, tmp_path):
    rng = random.Random(1)
    words = lambda n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäö", k=6)) for _ in range(n)]
    rows = []
    for k in range(40):
        same = words(280)
        rows += [(2 * k, " ".join(words(110) + same)), (2 * k + 1, " ".join(same + words(110)))]
    # Only the ends of these two differ.
    rows += [(200, "x" * 30_000 + " ".join(words(9))), (201, None), (202, ""), (203, rows[0][1].upper())]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    by = {r.verify: r for r in QUERIES["documents_quality"](spark, str(tmp_path)).collect()}
    assert by["exact"]["true"] >= 40 and by["exact"].recall >= 0.9 and by["exact"].precision == 1
    assert by["estimated"].recall >= 0.7
    members = {r.id: r.class_id for r in QUERIES["documents_members"](spark, str(tmp_path)).collect()}
    assert members[203] == 0 and members[202] == 201 and members[200] == 200
