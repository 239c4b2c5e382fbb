"""Easing curves as Column expressions; every curve maps 0 to 0 and 1 to 1."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Curve = Callable[[Column], Column]


def _power(n: int) -> Curve:
    def curve(t: Column) -> Column:
        out = t
        for _ in range(n - 1):
            out = out * t
        return out

    return curve


def _out(curve: Curve) -> Curve:
    return lambda t: 1 - curve(1 - t)


def _both(first: Curve, second: Curve) -> Curve:
    return lambda t: F.when(t < 0.5, first(2 * t) / 2).otherwise(second(2 * t - 1) / 2 + 0.5)


def _in_out(curve: Curve) -> Curve:
    return _both(curve, _out(curve))


def linear(t: Column) -> Column:
    return t


ease_in_quad, ease_in_cubic, ease_in_quart, ease_in_quint = (_power(n) for n in (2, 3, 4, 5))
ease_out_quad, ease_out_cubic, ease_out_quart, ease_out_quint = (_out(_power(n)) for n in (2, 3, 4, 5))
ease_in_out_quad, ease_in_out_cubic, ease_in_out_quart, ease_in_out_quint = (_in_out(_power(n)) for n in (2, 3, 4, 5))


def ease_in_sine(t: Column) -> Column:
    return 1 - F.cos(t * (math.pi / 2))


def ease_out_sine(t: Column) -> Column:
    return F.sin(t * (math.pi / 2))


def ease_in_out_sine(t: Column) -> Column:
    return (1 - F.cos(t * math.pi)) / 2


def ease_in_circ(t: Column) -> Column:
    return 1 - F.sqrt(1 - t * t)


ease_out_circ, ease_in_out_circ = _out(ease_in_circ), _in_out(ease_in_circ)


def ease_in_back(t: Column, overshoot: float = 1.0) -> Column:
    return t * t * t - overshoot * t * F.sin(t * math.pi)


def ease_out_back(t: Column, overshoot: float = 1.0) -> Column:
    return _out(lambda x: ease_in_back(x, overshoot))(t)


def ease_in_out_back(t: Column, overshoot: float = 1.0) -> Column:
    return _in_out(lambda x: ease_in_back(x, overshoot))(t)


def _elastic(overshoot: float, period: float) -> tuple[float, float, float]:
    amp = max(overshoot, 1.0)
    return amp, period / (2 * math.pi) * math.asin(1 / amp), 2 * math.pi / period


def _fixed_ends(t: Column, inner: Column) -> Column:
    return F.when((t == 0) | (t == 1), t).otherwise(inner)


def ease_in_elastic(t: Column, overshoot: float = 1.0) -> Column:
    amp, shift, speed = _elastic(overshoot, 0.3)
    return _fixed_ends(t, -amp * F.pow(F.lit(2.0), 10 * t - 10) * F.sin((t - 1 - shift) * speed))


def ease_out_elastic(t: Column, overshoot: float = 1.0) -> Column:
    amp, shift, speed = _elastic(overshoot, 0.3)
    return _fixed_ends(t, amp * F.pow(F.lit(2.0), -10 * t) * F.sin((t - shift) * speed) + 1)


def ease_in_out_elastic(t: Column, overshoot: float = 1.0) -> Column:
    amp, shift, speed = _elastic(overshoot, 0.45)
    u = 20 * t - 10
    wave = amp / 2 * F.sin((u - shift) * speed)
    return _fixed_ends(t, F.when(t < 0.5, -wave * F.pow(F.lit(2.0), u)).otherwise(wave * F.pow(F.lit(2.0), -u) + 1))


#: Upper ends of the bounces and their parabolas.
_BOUNCES = [(4 / 11, 121 / 16, 0.0, 0.0), (8 / 11, 363 / 40, -99 / 10, 17 / 5), (9 / 10, 4356 / 361, -35442 / 1805, 16061 / 1805), (None, 54 / 5, -513 / 25, 268 / 25)]


def ease_out_bounce(t: Column) -> Column:
    out = None
    for end, a, b, c in _BOUNCES:
        y = a * t * t + b * t + c
        out = y if end is None and out is None else F.when(t < end, y) if out is None else out.otherwise(y) if end is None else out.when(t < end, y)
    return out


ease_in_bounce = _out(ease_out_bounce)
ease_in_out_bounce = _both(ease_in_bounce, ease_out_bounce)

CURVES: dict[str, Curve] = {"linear": linear} | {f"ease_{d}_{k}": globals()[f"ease_{d}_{k}"] for k in ("quad", "cubic", "quart", "quint", "sine", "circ", "back", "elastic", "bounce") for d in ("in", "out", "in_out")}
