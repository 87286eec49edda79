"""Layered configuration and error codes."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    """Defaults; `load` puts a file's values, overrides and environment variables on top, in that order."""

    target_size: tuple[int, int] = (1280, 1280)
    resolution: float = 0.05
    min_room_area: float = 1.0
    wall_threshold: int = 128
    max_noise_area: int = 30
    dilate_iter: int = 2
    smooth_iterations: int = 2
    max_burr_len: int = 4
    max_extend: float = 3.0
    conf_threshold: float = 0.1
    nms_threshold: float = 0.35
    output_format: str = "yolo_obb"
    landmark_min_distance: float = 0.1
    min_part_area: float = 0.25
    door_width: int = 20
    grow_iterations: int = 10
    merge_area_threshold: float = 0.0
    merge_ratio_threshold: float = 0.6
    min_new_region_area: int = 50
    threshold_thickness: int = 10
    min_input_size: int = 416
    normalize: bool = False
    mean: tuple[float, ...] = (0.485, 0.456, 0.406)
    std: tuple[float, ...] = (0.229, 0.224, 0.225)
    service_version: str = "4.0.2"
    model_version_tag: str = "0.0.1"
    landmark_model: str = "S-K20PRO"
    default_model: str = "s10"

    @property
    def labels_version(self) -> str:
        return f"v{self.service_version}_{self.model_version_tag}"


def _cast(value, like):
    if not isinstance(value, str):
        return tuple(value) if isinstance(like, tuple) else type(like)(value)
    if isinstance(like, bool):
        return value.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(like, tuple):
        return tuple(type(like[0])(x) for x in value.split(","))
    return type(like)(value)


def load(file_values: Mapping | None = None, overrides: Mapping | None = None, environ: Mapping | None = None) -> Config:
    """Environment (upper-case names) over overrides over a file's values over defaults. Unknown names are ignored."""
    environ = os.environ if environ is None else environ
    out, base = Config(), asdict(Config())
    for layer in (file_values or {}, overrides or {}, {f.name: environ[f.name.upper()] for f in fields(Config) if f.name.upper() in environ}):
        out = replace(out, **{k: _cast(v, base[k]) for k, v in layer.items() if k in base and v is not None})
    return out


class MapError(Exception):
    """A business error with its code; 0 is any other failure."""

    code = 0

    def __init__(self, message: str = ""):
        super().__init__(message or self.__class__.__name__)
        self.message = str(self)


def _error(name: str, code: int) -> type[MapError]:
    return type(name, (MapError,), {"code": code, "__module__": __name__})


DataLoadError = _error("DataLoadError", 1)
InvalidResolutionError = _error("InvalidResolutionError", 2)
NoLabelsError = _error("NoLabelsError", 3)
InvalidParameterError = _error("InvalidParameterError", 4)
InsufficientIntersectionsError = _error("InsufficientIntersectionsError", 5)
RoomIndexOutOfRangeError = _error("RoomIndexOutOfRangeError", 7)
RoomsNotConnectedError = _error("RoomsNotConnectedError", 8)
OperationFailedError = _error("OperationFailedError", 9)
RoomTooSmallError = _error("RoomTooSmallError", 10)
StoreError = _error("StoreError", 11)
SplitNotConnectedError = _error("SplitNotConnectedError", 12)

#: Final states of a request.
OK, FAILED, BAD_ARGUMENT = 200, 190, 171
