"""Signal amplitudes from waveforms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The amplitude of a hit whose waveform is missing or empty.
DEFAULT_AMPLITUDE = 10
#: Places of the channels; for simulated events F is X.
CHANNELS, SIMULATED = {"F": 0, "X": 1, "Y": 2, "Z": 3}, {"F": 0, "X": 0, "Y": 1, "Z": 2}


def _part(trace: Column, left: int, right: int) -> Column:
    return F.slice(trace, F.lit(left + 1), F.lit(max(right - left, 0)))


def peak(trace: Column, left: int, right: int) -> Column:
    """The largest absolute value of trace[left:right] as an integer. A missing or empty trace gives the default, a
    trace that has nothing in the window null."""
    top = F.array_max(F.transform(_part(trace, left, right), lambda x: F.abs(x.cast("double"))))
    return F.when(F.coalesce(F.size(trace), F.lit(0)) <= 0, F.lit(DEFAULT_AMPLITUDE)).otherwise(top.cast("int"))


def peak_xy(x: Column, y: Column, left: int, right: int) -> Column:
    """The largest hypotenuse of two channels in the window."""
    top = F.array_max(F.zip_with(_part(x, left, right), _part(y, left, right), lambda a, b: F.hypot(a.cast("double"), b.cast("double"))))
    empty = (F.coalesce(F.size(x), F.lit(0)) <= 0) | (F.coalesce(F.size(y), F.lit(0)) <= 0)
    return F.when(empty, F.lit(DEFAULT_AMPLITUDE)).otherwise(top.cast("int"))


def channel(traces: Column, name: str, simulated: bool = False) -> Column:
    """One channel of a detector's array of channel traces; null where it has no such channel."""
    return F.get(traces, F.lit((SIMULATED if simulated else CHANNELS)[name]))


def amplitude(traces: Column, name: str, left: int, right: int, simulated: bool = False) -> Column:
    """peak() of the channel F, X, Y or Z, or peak_xy() for XY."""
    if name == "XY":
        return peak_xy(channel(traces, "X", simulated), channel(traces, "Y", simulated), left, right)
    return peak(channel(traces, name, simulated), left, right)
