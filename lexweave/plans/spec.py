"""Join specifications and parameters."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from ..operators.rewrite import MOST_TRANSFORMS, matched, profiled


@dataclass(frozen=True)
class Params:
    """Parameters of all strategies; names of the command line in brackets."""

    k: int = 1  # [K]
    q: int = 2  # [qSize]
    delta: int = 0
    dist: str = "edit"  # edit or lcs
    theta: float = 1.0
    sample: float | None = None  # [sampleB]
    sample_plan: float = 0.05  # [sampleH]
    order: str = "FF"  # FF or PF [ord]
    check: str = "DP"  # naive, greedy, DP, MIT_GR or GR<beam> [verify]
    beam: int = 2
    rc: bool = False
    use_lf: bool = True
    use_pqf: bool = True
    use_stpq: bool = True
    most: int = MOST_TRANSFORMS
    seed: int = 7

    def __post_init__(self):
        if self.k < 1 or self.q < 1 or self.delta < 0 or not 0 <= self.theta <= 1:
            raise ValueError("K and q are positive, delta is not negative, theta lies in 0..1")
        if self.dist not in ("edit", "lcs"):
            raise ValueError(f"distance {self.dist}")
        if self.order not in ("FF", "PF"):
            raise ValueError(f"order {self.order}")
        if self.check not in ("naive", "greedy", "DP", "MIT_GR", "beam"):
            raise ValueError(f"verifier {self.check}")

    def args(self) -> dict:
        return asdict(self)

    @classmethod
    def parse(cls, text: str) -> Params:
        """`-K 1 -qSize 2 -delta 1 -dist lcs -verify GR3 -useLF false ...`"""
        names = {"K": "k", "qSize": "q", "delta": "delta", "dist": "dist", "theta": "theta", "sampleB": "sample", "sampleH": "sample_plan", "ord": "order", "verify": "check", "rc": "rc", "lf": "use_lf", "useLF": "use_lf", "usePQF": "use_pqf", "useSTPQ": "use_stpq"}
        words, out = text.split(), {}
        for name, value in zip(words[::2], words[1::2], strict=True):
            key = names.get(name.lstrip("-"))
            if key is None:
                raise ValueError(f"parameter {name}")
            if key == "check" and value.startswith("GR") and value[2:].isdigit():
                out |= {"check": "beam", "beam": int(value[2:])}
            elif key in ("k", "q", "delta"):
                out[key] = int(value)
            elif key in ("theta", "sample", "sample_plan"):
                out[key] = float(value)
            elif key in ("rc", "use_lf", "use_pqf", "use_stpq"):
                out[key] = value.lower() == "true"
            else:
                out[key] = value
        return cls(**out)


@dataclass
class JoinSpec:
    """Records (id, raw, toks) to search with, records to find, rules (lhs, rhs)."""

    left: DataFrame
    right: DataFrame
    rules: DataFrame
    self_join: bool = False
    one_side: bool = False
    params: Params = field(default_factory=Params)

    @classmethod
    def of_self(cls, records: DataFrame, rules: DataFrame, **params) -> JoinSpec:
        return cls(records, records, rules, True, params=Params(**params))

    def searched(self) -> DataFrame:
        return profiled(matched(self.left, self.rules))

    def reversed(self) -> JoinSpec:
        return JoinSpec(self.right, self.left, self.rules, self.self_join, True, self.params)
