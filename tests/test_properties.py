"""Properties that hold for any input: bounds of shown numbers, addresses, formulas, lookups by position."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.address import MAX_COL, MAX_ROW, Range, column_of, letters, parse_a1
from tabulon.functions.evaluate import Err, Source, evaluate
from tabulon.functions.text import redact, scan_references, shape
from tabulon.sources.workbook import shifted
from tabulon.values import display, shown, shown_array, shown_bounds

numbers = st.floats(allow_nan=False, allow_infinity=False, min_value=-1e200, max_value=1e200)


@given(numbers)
def test_bounds_hold_just_the_numbers_that_show_alike(n):
    low, high = shown_bounds(n)
    assert low <= n <= high and shown(low) == shown(high) == shown(n)
    assert shown(math.nextafter(low, -math.inf)) != shown(n) and shown(math.nextafter(high, math.inf)) != shown(n)


@given(st.lists(numbers, min_size=1, max_size=50))
def test_arrays_round_like_single_numbers(xs):
    import numpy as np

    assert shown_array(np.array(xs)).tolist() == [shown(x) for x in xs]


@given(st.integers(0, MAX_COL), st.integers(0, MAX_ROW), st.integers(0, MAX_COL), st.integers(0, MAX_ROW))
def test_addresses_round_trip(c1, r1, c2, r2):
    r = Range.of(r1, c1, r2, c2)
    assert parse_a1(r.a1()) == (None, r) and column_of(letters(c1)) == c1


@settings(max_examples=60)
@given(st.integers(1, 50), st.integers(1, 50), st.integers(0, 20), st.integers(0, 20))
def test_a_filled_formula_keeps_its_shape(row, col, down, over):
    f = f"SUM({letters(col)}{row}:{letters(col + 1)}{row + 2},$B$3)*Other!{letters(col)}$4+1"
    moved = shifted(f, down, over)
    assert shape(moved, row + down, col + over) == shape(f, row, col)
    assert len(scan_references(moved)) == len(scan_references(f)) == 3
    assert redact(moved).endswith("+<number>")


@settings(max_examples=60)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.text("ab", max_size=1)), min_size=1, max_size=12), st.integers(-6, 6))
def test_approximate_match_is_the_last_position_at_or_below(column, key):
    source = Source({(0, i, 0): v for i, v in enumerate(column) if v is not None}, ["S"])
    places = [i for i, v in enumerate(column) if isinstance(v, float) and v <= key]
    want = float(places[-1] + 1) if places else Err("#N/A")
    assert evaluate(f"MATCH({key},A1:A{len(column)})", source, 0)[1] == want


@given(numbers)
def test_what_is_shown_reads_back(n):
    assert float(display(n)) == shown(n)
