"""Parameters of read and assembly mode. Defaults, presets and precedence are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Sketch:
    k: int = 17
    w: int = 21
    forward_only: bool = True


@dataclass(frozen=True)
class Refine:
    window: int = 100
    arm: int = 1200
    mode: str = "hifi"  # or "ont"
    max_ed_rate: float = 0.25
    max_jump_clip: int = 1000


@dataclass(frozen=True)
class Signature:
    flank: int = 1000
    take: int = 12
    shift: int = 0


@dataclass(frozen=True)
class ReadConfig:
    sketch: Sketch = field(default_factory=Sketch)
    refine: Refine = field(default_factory=Refine)
    sig: Signature = field(default_factory=Signature)
    min_matches: int = 10
    min_arm: int = 200
    end_guard: int = 1000
    diag_tol: int = 120
    bucket_cap: int = 64
    min_identity: float = 0.60
    min_support: int = 3
    min_support_ident: float = 0.0
    max_depth: int = 5
    cut_low_ident: bool = False
    split_quantum: int = 150

    @property
    def least_length(self) -> int:
        return self.sketch.k + self.sketch.w + 10


# Fixed values of the presets: min_matches, min_arm, min_identity, min_support, max_depth, signature (flank, take, shift).
PRESETS = {
    "strict": (30, 3000, 0.75, 5, 2, (800, 10, 0)),
    "balanced": (20, 2000, 0.60, 3, 5, (600, 8, 0)),
    "permissive": (12, 1200, 0.50, 2, 8, (200, 6, 8)),
}


def read_config(preset: str = "balanced", mode: str = "hifi", fairness: bool = False, **flags) -> ReadConfig:
    """Preset, then explicit flags (k, w, window, arm, flank, take, shift and the fields of ReadConfig), then fairness on top.

    In ont mode k and w are 11 unless given. Fairness fixes the comparison baseline whatever the flags say.
    """
    if preset not in PRESETS:
        raise ValueError(f"no preset {preset!r}")
    mm, arm, ident, sup, depth, sig = PRESETS[preset]
    c = ReadConfig(min_matches=mm, min_arm=arm, min_identity=ident, min_support=sup, max_depth=depth, sig=Signature(*sig))
    c = replace(c, refine=replace(c.refine, mode=mode))
    if mode == "ont":
        c = replace(c, sketch=Sketch(11, 11))
    elif mode != "hifi":
        raise ValueError(f"no mode {mode!r}")
    inner = {"sketch": ("k", "w", "forward_only"), "refine": ("window", "arm", "max_ed_rate", "max_jump_clip"), "sig": ("flank", "take", "shift")}
    for part, names in inner.items():
        got = {n: flags.pop(n) for n in names if flags.get(n) is not None}
        c = replace(c, **{part: replace(getattr(c, part), **got)})
    c = replace(c, **{n: v for n, v in flags.items() if v is not None})
    if fairness:
        c = replace(
            c, sketch=Sketch(17, 21), refine=replace(c.refine, mode="hifi", window=200, arm=1200), min_matches=20, min_arm=1000,
            min_identity=0.60, min_support=2, max_depth=1, end_guard=1000, diag_tol=120,
        )
    return c


@dataclass(frozen=True)
class AssemblyConfig:
    """Inverted-repeat scan of contigs."""

    sketch: Sketch = field(default_factory=Sketch)
    refine: Refine = field(default_factory=lambda: Refine(window=500))
    min_matches: int = 20
    min_arm: int = 2000
    end_guard: int = 0
    diag_tol: int = 120
    bucket_cap: int = 64
    window_len: int = 250_000
    step: int = 50_000
    hits_per_window: int = 4
    max_interval: int = 250_000
    dedup: int = 200
    diag_widen: int = 4
    trim_lo: float = 0.10
    trim_hi: float = 0.90
    immediate: int = 2000
    wide: int = 100_000
    cap_policy: str = "penalize"  # or "clamp", "drop"
    proxy_gate: float = 0.65

    @property
    def least_length(self) -> int:
        return self.sketch.k + self.sketch.w + 10
