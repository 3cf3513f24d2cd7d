"""Settings of a data set and of training, from YAML; what is missing raises at once."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path


class SettingsError(KeyError):
    """Keys that are not there, or values that are not allowed."""


#: The folders of a data set, and the variable that overrides its raw one.
FOLDERS = ("raw_root", "processed_root", "synced_root", "splits_dir", "split_manifest", "normalization_dir", "reports_dir")
RAW_ROOT = "WAYLINE_RAW_ROOT"
#: What a training run needs, by section.
NEEDED = {
    "data": "window_samples stride_train stride_eval max_window_dt_s min_gt_valid_fraction max_speed_mps verified_only",
    "features": "raw_channels gyro_vertical_channel invariant accel_scale_mps2 gyro_scale_radps",
    "augmentation": "enabled accel_noise_mps2 gyro_noise_radps accel_bias_mps2 time_jitter_s rotation max_tilt_deg",
    "train": "batch_size min_batch_size lr weight_decay epochs grad_clip huber_delta nll_weight logvar_clamp early_stopping_patience device",
}
ROTATIONS = ("yaw_tilt", "full", "none")


@dataclass(frozen=True)
class DataSet:
    name: str
    folders: dict[str, Path]
    source: Path

    def __getitem__(self, folder: str) -> Path:
        return self.folders[folder]


def _read(path: str | Path) -> dict:
    import yaml

    doc = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if doc.get("schema_version") != 1:
        raise SettingsError(f"{path}: schema_version {doc.get('schema_version')!r} is not 1")
    return doc


def data_set(path: str | Path) -> DataSet:
    """The folders of a data set; relative ones start at the file's folder. RAW_ROOT in the environment goes before raw_root."""
    source = Path(path)
    own = _read(source).get("dataset", {})
    missing = [k for k in ("name", *FOLDERS) if k not in own]
    if missing:
        raise SettingsError(f"{path}: missing {missing}")
    asked = dict(own) | ({"raw_root": os.environ[RAW_ROOT]} if os.environ.get(RAW_ROOT) else {})
    return DataSet(own["name"], {k: (source.parent / asked[k]).resolve() for k in FOLDERS}, source)


def training(path: str | Path) -> dict:
    """The settings of a training run, every needed key there."""
    doc = _read(path)
    missing = ([] if "seed" in doc else ["seed"]) + [f"{s}.{k}" for s, names in NEEDED.items() for k in names.split() if k not in doc.get(s, {})]
    missing += [f"models.{m}.{k}" for m in ("model_a", "model_b") for k in ("arch", "target", "hidden", "dropout") if k not in doc.get("models", {}).get(m, {})]
    if missing:
        raise SettingsError(f"{path}: missing {missing}")
    if doc["augmentation"]["rotation"] not in ROTATIONS:
        raise SettingsError(f"augmentation.rotation must be one of {ROTATIONS}")
    return doc
