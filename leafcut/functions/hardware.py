"""Step functions of memory, and settings with their checks."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds in GB (None: no bound) and what applies below them.
GPU_BATCH = [(1.5, 5), (2.5, 8), (3.5, 15), (5, 25), (7, 35), (10, 50), (None, 60)]
CPU_BATCH = [(6, 3), (10, 5), (20, 10), (28, 15), (None, 20)]
GPU_DPI = [(2, 200), (4, 300), (6, 400), (None, 600)]
CPU_DPI = [(6, 150), (10, 200), (20, 300), (None, 450)]
QUALITY_DPI = {"low": 150, "balanced": 300, "high": 450, "max": 600}
MODEL_TIERS = [(2, "cpu"), (4, "2gb"), (6, "4gb"), (8, "6gb"), (None, "8gb")]
DECODE_RATE = {"8gb": (50, 1.0), "6gb": (40, 1.5), "hybrid": (25, 2.0), "cpu": (5, 5.0)}


def step(x: Column, table: list[tuple]) -> Column:
    out = F.lit(table[-1][1])
    for bound, value in reversed(table[:-1]):
        out = F.when(x < bound, value).otherwise(out)
    return out


def batch_size(gb: Column, gpu: bool) -> Column:
    return step(gb, GPU_BATCH if gpu else CPU_BATCH)


def adaptive_dpi(gb: Column, gpu: bool, quality: str = "balanced") -> Column:
    return F.least(F.lit(QUALITY_DPI.get(quality, 300)), step(gb, GPU_DPI if gpu else CPU_DPI))


def memory_pressure(used: Column) -> Column:
    return F.when(used >= 0.95, "critical").when(used >= 0.85, "high").when(used >= 0.75, "medium").when(used >= 0.60, "low").otherwise("none")


def adjusted_batch(n: Column, pressure: Column) -> Column:
    most = F.greatest(F.lit(1), F.floor(n / 4))
    return (
        F.when(pressure == "critical", most)
        .when(pressure == "high", F.greatest(F.lit(1), F.floor(n / 2)))
        .when(pressure == "medium", F.greatest(F.lit(1), F.floor(n * F.lit(0.75))))
        .when(pressure == "low", n)
        .otherwise(F.least(n + 5, n * 2))
        .cast("int")
    )


def model_tier(gb: Column) -> Column:
    return step(gb, MODEL_TIERS)


def decode_seconds(tokens: Column, tier: str) -> Column:
    rate, overhead = DECODE_RATE[tier]
    return tokens / F.lit(float(rate)) + F.lit(overhead)


def hybrid_mode(gpu: Column, vram_gb: Column, ram_gb: Column) -> Column:
    return gpu & (vram_gb <= 4.5) & (ram_gb >= 15)


@dataclass
class Settings:
    """Settings of the language-model step."""

    enabled: bool = True
    refine_splits: bool | None = None
    name_documents: bool = True
    min_confidence: float = 0.6
    cache_ttl_days: int = 30
    context: int = 4096
    model: str = "auto"
    gpu_layers: int | None = None

    def problems(self) -> list[str]:
        out = []
        if not 0 <= self.min_confidence <= 1:
            out.append("min_confidence")
        if self.cache_ttl_days < 1:
            out.append("cache_ttl_days")
        if self.context not in (512, 1024, 2048, 4096, 8192):
            out.append("context")
        if self.model not in ("auto", "phi3_mini", "gemma2_2b"):
            out.append("model")
        if self.gpu_layers is not None and not 0 <= self.gpu_layers <= 40:
            out.append("gpu_layers")
        return out

    @classmethod
    def load(cls, path: str) -> Settings:
        """Unknown keys are dropped; a missing file is written with the defaults."""
        p = Path(path)
        if not p.exists():
            cls().save(path)
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(p.read_text()).items() if k in known})

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    def updated(self, path: str, **changes: object) -> Settings:
        """Known settings changed and saved; unknown names are ignored."""
        known = {f.name for f in fields(self)}
        out = replace(self, **{k: v for k, v in changes.items() if k in known})
        out.save(path)
        return out

    @classmethod
    def reset(cls, path: str) -> Settings:
        """The defaults, saved."""
        out = cls()
        out.save(path)
        return out
