"""Names of the five-minute columns by family, and the lists of columns that a step needs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

# Columns of the five-minute tables by family, and those that highfreq.electrical() computes.

ELECTRIC = ("imfc", "umfc", "rmfc", "rkfc")
COMPUTED = ("power_mw", "i2r_mw", "i2_diff_mw", "r_diff", "r_ratio")
CONTROL = ("rthfc", "smrwfc", "wrmfc", "rcmfc", "rdemfc", "rcfc", "rcacfc", "ruccfc", "rcdlfc", "rabbfc", "rcdafc", "rcocfc", "rwtbffc", "rmiarfc")
FEED = ("pentefc", "cdordfc", "scdocc")
FEED_STATES = ("crustbrk_int", "feeder_int", "al2o3_feed_ph2v", "al2o3_feed_ph1", "al2o3_feed_ph2i", "al2o3_overfeed", "prg_tracking", "ctl_tracking")
INSTABILITY_STATES = ("mild_instability", "sever_instability", "extd_instability")
ANODIC_STATES = ("anode_effect",)
OPERATION_STATES = (
    "potmicro_local", "anode_up_limit", "anode_dw_limit", "anode_cover", "remain_order", "order_tl", "beam_heeling", "beam_manual", "beam_psu", "order_discrepancy", "prep_before_sd",
    "line_sd", "restart_after_sd", "voltage_tapping", "tapping", "anode_change", "voltage_beam", "oversuccion", "potmicro_local_fc", "beam_manual_fc", "interrupt_cyc",
)

SIGNALS = {"electric": (*ELECTRIC, *COMPUTED), "control": CONTROL, "feed": ("feed_clean", *FEED)}
STATES = {"feed": FEED_STATES, "instability": INSTABILITY_STATES, "anodic": ANODIC_STATES, "operation": OPERATION_STATES}


def unique(*lists: Iterable[str]) -> list[str]:
    """All names once, in order of their first place."""
    return list(dict.fromkeys(n for names in lists for n in names))


def prefixes(families: dict[str, Sequence[str]], lead: str = "h5") -> dict[str, str]:
    """The readable name of each column: lead, family and column."""
    return {c: f"{lead}_{family}_{c.lower()}" for family, columns in families.items() for c in columns}


def record_columns(cell: str = "cell", ts: str = "ts", mode: str = "talimfc", feed: str = "pal2o3fc") -> list[str]:
    """What a scan of five-minute records has to read: keys, mode, the raw feed signal, and all signals and states that aren't computed."""
    raw = [c for columns in SIGNALS.values() for c in columns if c not in (*COMPUTED, "feed_clean")]
    return unique([cell, ts, mode, feed], raw, *STATES.values())


def slot_columns(signals: Sequence[str], states: Sequence[str], modes: Sequence[str], cell: str = "cell", order: str = "ord") -> list[str]:
    """What the ledger has to read of slot partials (see highfreq.slot_partials())."""
    return unique(
        [cell, order, "records", "changes"],
        [f"{s}__{k}" for s in signals for k in ("mean", "count", "min", "max")],
        [f"{s}__{k}" for s in states for k in ("active", "any")],
        [f"{m}__records" for m in modes],
    )
