from weftlight.llm.language import word_features


def test_letters_beyond_the_fortieth_make_features():
    owner, bucket = word_features(["a" * 40 + "xyz", "a" * 40 + "qrs"])[:2]
    one, two = (set(bucket[owner == i].tolist()) for i in (0, 1))
    assert one != two
