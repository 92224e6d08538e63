"""Token counts by the whole vocabulary, of whole pre-tokens."""

from corvex.llm import token_count


def brute(word: bytes, scores: dict, longest: int) -> int:
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        best.append(max((best[k][0] + scores[word[k:end]], best[k][1] - 1) for k in range(max(0, end - longest), end) if word[k:end] in scores))
    return -best[-1][1]


def test_long_pieces_and_long_pre_tokens(spark):
    scores, longest = token_count.vocabulary(token_count.VOCABULARY)
    assert longest > 16
    texts = [" responsibilities", " unconstitutional", "-" * 64, "=" * 130, "x _" + "*" * 77, "漢字" * 3000, "QUJDRA" * 1500, " " * 9000 + "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_count.token_counts(docs).collect()}
    for i, t in enumerate(texts):
        words = token_count.PRE_TOKEN.findall(t)
        assert got[i]["n_pretokens"] == len(words)
        assert got[i]["n_tokens"] == sum(brute(w.encode(), scores, longest) for w in words), t[:20]
    assert [got[i]["n_tokens"] for i in range(3)] == [1, 1, 1]


def test_window_of_scores():
    scores = {b"a": -2.0, b"b": -2.0, b"ab": -1.0, b"aba": -1.5, b"bbbbb": -3.0}
    words = [b"ab" * 40, b"ab" * 40 + b"a", b"abbbbb" * 9, b"b" * 53, b"aab", b"aab" * 11]
    got = token_count.count_walked(words, token_count.with_tails(scores), 5, most=7)
    assert got == {w: brute(w, scores, 5) for w in words}
