from hypothesis import given
from hypothesis import strategies as st

from inkwell.functions.syntax import Name, Op, Ref, first_value, tokens, values


def all_(data):
    return [v for _, v, _ in values(data)]


def test_numbers_names_words():
    assert all_(b"1 -2 +3 .5 -1.25 4. true false null /A#42c /a.b foo") == [1, -2, 3, 0.5, -1.25, 4.0, True, False, None, "ABc", "a.b", "foo"]
    assert isinstance(all_(b"/A")[0], Name) and isinstance(all_(b"q")[0], Op)


def test_comments_are_dropped():
    assert all_(b"1 % two (\n3") == [1, 3]


def test_strings():
    assert all_(rb"(a(b)c\)\050\53\n\
d)") == [b"a(b)c)(+\nd"]
    assert all_(b"(a\r\nb\rc)") == [b"a\nb\nc"]
    assert all_(b"<48 65 6c 6c 6f> <901FA>") == [b"Hello", b"\x90\x1f\x0a"]


def test_nesting_and_references():
    assert all_(b"<< /A [1 2 << /B (x) >>] /C 3 0 R /D null >> [4 0 R 5]") == [{"A": [1, 2, {"B": b"x"}], "C": Ref(3)}, [Ref(4), 5]]
    assert all_(b"1 2 3 0 R 4") == [1, 2, Ref(3), 4]


def test_places():
    assert [(s, e) for s, _, e in tokens(b"ab 12")] == [(0, 2), (3, 5)]
    assert first_value(b" 7 endobj") == (7, 2)


@given(st.binary(max_size=300))
def test_any_bytes_end(data):
    list(values(data))


@given(st.binary(max_size=200))
def test_string_round_trip(data):
    from inkwell.plans.synth import escaped

    assert all_(b"(" + escaped(data) + b")") == [data]
