"""Line features do not depend on a switch by length."""

from gridlark.llm import quality

DIGITS = quality.FEATURES.index("digits")


def test_digits_are_counted_in_lines_of_every_length():
    for n in (10, 399, 400, 401, 5000):
        line = ("12345 " * n)[:n]
        assert quality.line_features(line, False)[DIGITS]
        assert not quality.line_features(("abcde " * n)[:n], False)[DIGITS]
