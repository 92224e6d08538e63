"""Every kind of base span seeds patterns, blanks or not, and contexts hold marked words and the text's start."""

import pytest

from corvex.llm import pii

PHONE = "+1 (017) 555-77{:02}"
CARDS = ["4111 1111 1111 1111", "5500 0000 0000 0004", "3530 1113 3330 0000", "6011 0000 0000 0004", "4012 8888 8888 1881"]


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in pii.pii_spans(docs).collect()}


@pytest.mark.parametrize("before, seeds", [
    ("please call me on ", [PHONE.format(i) for i in range(5)]),
    ("paid by the card ", CARDS),
    ("ID: ", [f"u{i}@mail.org" for i in range(5)]),
    ("on 2024 reach ", [PHONE.format(i) for i in range(5)]),
    ("write <mail:", [f"u{i}@mail.org" for i in range(5)]),
    ("", [f"u{i}@mail.org" for i in range(5)]),
])
def test_seeds(spark, before, seeds):
    unseen = before.replace("<mail:", "mail: ") + "8841-22 then more"
    got = found(spark, [f"{before}{s} now" for s in seeds] + [unseen, "no such thing 9911-22 here"])
    at = unseen.index("8841")
    assert got[len(seeds)]["spans"] == f"context:{at}:{at + 7}"
    assert got[len(seeds) + 1]["n_context"] == 0


def test_contexts_do_not_depend_on_lengths(spark):
    word = "w" * 60
    got = found(spark, [f"{word} {word}{' ' * 60}u{i}@mail.org" for i in range(4)] + [f"{word} {word} 8841-22", f"x{word} {word} 8841-22"])
    assert got[4]["n_context"] == 1 and got[5]["n_context"] == 0
