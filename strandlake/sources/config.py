"""Typed configuration: dataclasses, presets, and a YAML file of parameters that a search updates."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from pathlib import Path


@dataclass
class Svm:
    C: float = 1.0
    gamma: str = "scale"
    kernel: str = "rbf"
    tol: float = 1e-3
    class_weight: dict[int, float] = field(default_factory=lambda: {0: 1.0, 1: 1.0})
    decision_function_shape: str = "ovr"


@dataclass
class Preprocess:
    least_5: int = 16
    most_5: int = 1600
    least_3: int = 16
    most_3: int = 16000
    samples: int = 2000
    drop_n: bool = False
    upper: bool = False


@dataclass
class Config:
    svm: Svm = field(default_factory=Svm)
    preprocess: Preprocess = field(default_factory=Preprocess)
    windows: list[int] = field(default_factory=lambda: [10, 25, 50])
    step: int = 10
    seed: int = 42


#: Length limits of the two kinds of region and samples; parameters, windows and step of the models of either boundary,
#: by themselves and at the end of the whole pipeline.
PRESETS = {
    "preprocessing": Config(preprocess=Preprocess(16, 1600, 16, 16000, 2000)),
    "start": Config(Svm(196.7236684465528, "auto", "rbf", 0.07805291762864555, {0: 1.0, 1: 1.0}, "ovr"), windows=[100], step=5),
    "end": Config(Svm(165.64405117819743, "auto", "rbf", 0.062356369678597236, {0: 1.0, 1: 2.0}, "ovo"), windows=[250, 500, 1000, 2000], step=5),
    "pipeline_start": Config(Svm(85.73095986778094, "scale", "rbf", 0.08917730007820798, {0: 1.0, 1: 2.0}, "ovo"), Preprocess(50, 1500, 100, 15000, 2000), [10, 25], 5),
    "pipeline_end": Config(Svm(196.93249763961953, "auto", "linear", 0.024442559200160276, {0: 1.0, 1: 1.0}, "ovo"), windows=[250, 500], step=5),
}


def load(path: str) -> Config:
    import yaml

    raw = yaml.safe_load(Path(path).read_text()) or {}
    base = Config()
    return replace(
        base, svm=replace(base.svm, **raw.get("params", {})), preprocess=replace(base.preprocess, **raw.get("preprocess", {})), **{k: raw[k] for k in ("windows", "step", "seed") if k in raw}
    )


def save(config: Config, path: str) -> None:
    import yaml

    raw = asdict(config)
    Path(path).write_text(yaml.safe_dump({"params": raw.pop("svm")} | raw))


def update_params(path: str, params: dict) -> None:
    """Replaces the block ``params`` of a file; numbers of other libraries become plain ones."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text()) or {}
    raw["params"] = {k: v.item() if hasattr(v, "item") else v for k, v in params.items()}
    Path(path).write_text(yaml.safe_dump(raw))
