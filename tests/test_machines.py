"""Hand-worked cases of the state machines that the indicator tests do not cover."""

import math

import pytest

from tickloom.operators import machines as m


def run(step, rows, **params):
    state = {}
    return [step(state, *r, **params) for r in rows]


def test_ease_of_movement_freezes_its_anchor_once_it_emits():
    out = run(m.ease_of_movement, [(10, 8, 2), (12, 10, 2), (13, 11, 2), (20, 18, 2)], length=2)
    # moves 2 and 1; then 8 from the second bar, which was the last not to emit
    assert out[:2] == [None, None] and out[2] == (1.5,) and out[3] == (4.5,)


def test_demand_repeats_on_a_flat_bar():
    out = run(m.demand, [(10, 100), (12, 110), (12, 120), (15, 130)], length=1)
    raw = lambda p, v: math.log(p) * math.log(v) / (math.log(p) - math.log(v))
    assert out[0] is None and out[1] == pytest.approx((raw(2, 10),)) and out[2] == out[1] and out[3] == pytest.approx((raw(3, 20),))


def test_fisher_triggers_on_its_last_value():
    out = run(m.fisher, [(0.25,), (None,), (0.1,)])
    first = 0.5 * math.log(1.165 / 0.835)
    assert out[0] == pytest.approx((first, 0.0)) and out[1] is None and out[2][1] == pytest.approx(first)


def test_mcginley_starts_at_its_seed():
    out = run(m.mcginley, [(1.0, None), (3.0, 2.0), (4.0, None)], length=2)
    assert out[:2] == [None, (2.0,)] and out[2] == pytest.approx((2 + 2 / (1.2 * 16),))


def test_interleaved_buffer_holds_prices_and_averages():
    out = run(m.interleaved, [(2,), (4,), (6,)], length=2)
    # window 2,4: average 3, then 4,3 is left; with 6: 3,6 averages 4.5, and 6 leads
    assert out[0] is None and out[1] == pytest.approx(((3 - 4) / 4 * 100,)) and out[2] == pytest.approx(((4.5 - 6) / 6 * 100,))


def test_kalman_waits_for_its_length():
    out = run(m.kalman, [(1.0,), (2.0,), (None,), (2.0,)], process=0.0, measurement=1.0, length=2)
    assert out[0] is None and out[1] == pytest.approx((1.5,)) and out[2] is None and out[3] == pytest.approx((1.5 + 0.5 / 3,), abs=1e-6)


def test_trailing_reverse_turns_under_its_line():
    out = run(m.trailing_reverse, [(10.0,), (12.0,), (9.0,)], length=1, multiple=0.1)
    # trails 1.2 under 12, then 0.9 over 9
    assert out[1] == pytest.approx((10.8,)) and out[2] == pytest.approx((9.9,))


def test_pivots_keep_their_distance():
    out = run(m.spaced, [(None, None), (None, None), (5, None), (6, None), (None, 1), (7, None)], length=3)
    assert out == [(None, None), (None, None), (5, None), (None, None), (None, 1), (7, None)]
