"""Small driver-side documents: sessions, views, captions, file names, flags."""

from __future__ import annotations

import re
import secrets
from dataclasses import dataclass, field
from datetime import date

from ..errors import require

#: Letters and digits that can't be mistaken for each other; layers of a session; severities.
ALPHABET, CODE_LENGTH, LAYERS_MAX, SEVERITIES = "23456789ABCDEFGHJKLMNPQRSTUVWXYZ", 6, 100, ("info", "warning", "error")


def short_code() -> str:
    return "".join(secrets.choice(ALPHABET) for _ in range(CODE_LENGTH))


def normalise_layers(layers: list[dict]) -> list[dict]:
    """Session layers with an id, visible and opacity from 0 to 1; repeated ids and too many are refused."""
    require(len(layers) <= LAYERS_MAX, f"a session holds {LAYERS_MAX} layers, not {len(layers)}; remove some")
    out, seen = [], set()
    for x in layers:
        require("id" in x, "a layer of the session has no id")
        require(x["id"] not in seen, f"layer {x['id']} is in the session twice")
        seen.add(x["id"])
        opacity = float(x.get("opacity", 1.0))
        require(0 <= opacity <= 1, f"opacity is 0 to 1, not {opacity}")
        out.append({"id": x["id"], "visible": bool(x.get("visible", True)), "opacity": opacity})
    return out


def normalise_view(view: dict) -> dict:
    """A box with rising sides, or a centre and a zoom of 0 to 24."""
    if "bbox" in view:
        b = [float(v) for v in view["bbox"]]
        require(len(b) == 4 and b[0] < b[2] and b[1] < b[3], f"a box is west, south, east, north, not {b}")
        return {"bbox": b}
    zoom, centre = float(view.get("zoom", 0)), [float(v) for v in view.get("center", (0, 0))]
    require(0 <= zoom <= 24, f"zoom is 0 to 24, not {zoom}")
    require(len(centre) == 2 and abs(centre[0]) <= 180 and abs(centre[1]) <= 90, f"a centre is longitude, latitude, not {centre}")
    return {"zoom": zoom, "center": centre}


def caption(metadata: dict) -> str:
    return " · ".join(str(metadata[k]) for k in ("title", "source", "date") if metadata.get(k))


def filename(name: str, fmt: str, on: date) -> str:
    stem = re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_").lower() or "layer"
    return f"{stem}_{on:%Y%m%d}.{ {'geojson': 'geojson', 'csv': 'csv', 'parquet': 'parquet', 'shapefile': 'zip', 'gpkg': 'gpkg'}[fmt]}"


@dataclass
class Flags:
    """Findings beside a result: (code, severity, message, details)."""

    found: list[dict] = field(default_factory=list)

    def add(self, code: str, severity: str, message: str, **details) -> None:
        require(severity in SEVERITIES, f"severity {severity!r} is not one of {', '.join(SEVERITIES)}")
        self.found.append({"code": code, "severity": severity, "message": message, "details": {k: str(v) for k, v in details.items()}})

    def frame(self, spark):
        return spark.createDataFrame([(f["code"], f["severity"], f["message"], f["details"]) for f in self.found], "code string, severity string, message string, details map<string,string>")
