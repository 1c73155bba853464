"""Number formats: codes of all kinds, built-in ones, odd codes and numbers."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.operators import number_formats as formats

CASES = [
    ("0;-0;\"none\"", 0, "none"), ("[>=100]0;[<=-100]\"low\"0;\"mid\"", 50, "mid"), ("[>=100]0;[<=-100]\"low\"0;\"mid\"", -150, "low150"), ("[<1]0%;0.0", 0.25, "25%"), ("[<1]0%;0.0", 3, "3.0"),
    ("0.00E+00", 12345.678, "1.23E+04"), ("##0.0E+0", 12345.678, "12.3E+3"), ("##0.0E+0", 0, "0.0E+0"), ("0.0E-0", 0.00012, "1.2E-4"), ("0.0E+0", 9.96, "1.0E+1"), ("##0.0E+0", 999.96, "1.0E+3"),
    ("# ??/??", 3.14159, "3 14/99"), ("# ?/8", 2.6, "2 5/8"), ("# ?/?", 3, "3    "), ("# ?/2", 0.99, "1    "), ("# ?/?", -0.5, "- 1/2"),
    ("[$€-407] #,##0.00", -1234.5, "-€ 1,234.50"), ("0.00;;", -1, ""), ("0_)", 4, "4 "), ("0,000", 5, "0,005"), ("0.00", 2.675, "2.68"), ("0.00", -0.001, "-0.00"), ("#", 0, ""), ("#,##0.00", 1234567.891, "1,234,567.89"),
    ("A/P h", 0.6, "P 2"), ("ss.00", 1.256 / 86400, "01.26"), ("[hh]:mm:ss", 0.0001, "00:00:09"), ("h:mm:ss", 0.999999, "0:00:00"), ("yyyy-mm-dd", -1, "-1"), ("yyyy-mm-dd", 1e12, "1000000000000"), ("hh:mm m/d", 45000.25, "06:00 3/15"),
    ('"<"@">"', 3, "<3>"), ("General", 0.1, "0.1"), ('"n/a"', 5, "n/a"), ('"n/a"', -5, "-n/a"), ("", 2.50, "2.5"), ("@", 1e20, "1e+20"),
]


@pytest.mark.parametrize(("code", "value", "want"), CASES)
def test_codes(code, value, want):
    assert formats.shown_number(value, code) == want


def test_built_in_codes_and_epochs():
    assert formats.shown_number(-1234.5, formats.BUILT_IN[39]) == "(1,234.50)"
    assert formats.shown_number(0, formats.BUILT_IN[41]) == " - "
    assert formats.shown_number(1.5, formats.BUILT_IN[46]) == "36:00:00"
    assert formats.shown_number(0, "yyyy-mm-dd", epoch_1904=True) == "1904-01-01"


def test_text_sections():
    for code, want in (('0;0;0;"t:"@', "t:x"), ('"<"@">"', "<x>"), ("0.00", "x"), ("@", "x"), (None, "x"), ('0;-0;;"hid"', "x")):
        assert formats.shown_text("x", code) == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(list("0#?.,%/E+-@;[]<>=\"\\_* ymdhs:$") + ["[h]", "[Red]", "General", "AM/PM", "[>1]", "E+0", "0.0"]), max_size=12).map("".join), st.floats(allow_nan=False, allow_infinity=False, width=32))
def test_any_code_and_number(code, value):
    assert isinstance(formats.shown_number(value, code), str)
    assert isinstance(formats.shown_text("t", code), str)
