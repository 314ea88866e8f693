"""Signal quality, airtime and delay as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least SNR in dB at which each spreading factor still decodes.
SNR_FLOOR = {7: -7.5, 8: -10.0, 9: -12.5, 10: -15.0, 11: -17.5, 12: -20.0}
DEFAULT_FLOOR = -10.0


def packet_score(snr: Column, length: Column, spreading_factor: int = 8) -> Column:
    """0 to 1: headroom above the SNR floor (10 dB is full), less the share of 256 bytes that the packet takes."""
    if spreading_factor < 7:
        return F.lit(0.0)
    floor = SNR_FLOOR.get(spreading_factor, DEFAULT_FLOOR)
    raw = (snr - floor) / 10.0 * (1.0 - length / 256.0)
    return F.when(snr < floor, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def symbol_ms(spreading_factor: int, bandwidth_hz: float) -> float:
    return 2**spreading_factor / (bandwidth_hz / 1000.0)


def airtime_ms(length: Column, spreading_factor: int = 7, bandwidth_hz: float = 125_000) -> Column:
    """Preamble of 8 symbols and 8 symbols a byte, with 4.25 bytes of overhead: an estimate, as the radio's own formula isn't known here."""
    symbol = symbol_ms(spreading_factor, bandwidth_hz)
    return F.lit(8 * symbol) + (length + 4.25) * 8 * symbol


def tx_delay_s(route: Column, airtime: Column, draw: Column, score: Column, factor: float = 1.0, direct_s: float = 0.5, damp: bool = False) -> Column:
    """Seconds to wait before a packet is sent on. draw: a uniform number in 0 to 5, an input so that results can be repeated.

    Floods wait in proportion to their airtime; everything else a constant. With ``damp`` good packets go earlier. At most 5 s.
    """
    delay = F.when(route == 1, airtime * 52 / 50 / 2 * draw * factor / 1000).otherwise(F.lit(direct_s))
    if damp:
        delay = F.when(delay >= 0.05, delay * F.greatest(F.lit(0.2), 1 - score)).otherwise(delay)
    return F.least(F.lit(5.0), delay)


def snr_byte(snr: Column) -> Column:
    """Quarter decibels cut to a whole number, held to -128 .. 127, as an unsigned byte."""
    return F.pmod(F.greatest(F.lit(-128), F.least(F.lit(127), (snr * 4).cast("int"))), F.lit(256))


def snr_from_byte(value: Column) -> Column:
    return F.when(value > 127, value - 256).otherwise(value) / 4.0


def percent_of_budget(used_ms: Column, budget_ms: float = 3600.0) -> Column:
    return F.lit(100.0) * used_ms / budget_ms


def sensitivity(peak: Column, least: Column, rate: Column) -> Column:
    """Calibration score: 100 less the distance of the adjusted rate from 20 % and of the thresholds from 25 and 15."""
    return F.greatest(F.lit(0.0), 100.0 - F.abs(rate - 20.0) / 20.0 * 50.0 - (F.abs(peak - 25) + F.abs(least - 15)) / 20.0 * 20.0)


def first_of(*rules: tuple[Column, Column | str | None]) -> Column:
    """The value of the first rule whose condition holds."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    return reduce(lambda chain, rule: chain.when(rule[0], value(rule[1])), rules[1:], F.when(rules[0][0], value(rules[0][1])))
