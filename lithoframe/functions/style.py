"""Palettes, ramps, categorised and graduated symbols, legends and labels."""

from __future__ import annotations

import json
import math
import re
import xml.etree.ElementTree as ET

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import require

Stops = list[tuple[float, str]]


def parse_hex(value: str) -> tuple[int, int, int]:
    m = re.fullmatch(r"#?([0-9A-Fa-f]{3}|[0-9A-Fa-f]{6})", value.strip())
    require(m is not None, f"colour {value!r} is not of the form #rgb or #rrggbb")
    h = m[1] if len(m[1]) == 6 else "".join(c * 2 for c in m[1])
    return tuple(int(h[i : i + 2], 16) for i in (0, 2, 4))


def to_hex(rgb: tuple[float, float, float]) -> str:
    return "#" + "".join(f"{max(0, min(255, math.floor(c + 0.5))):02x}" for c in rgb)


def colour_column(stops: Stops, position: Column, discrete: bool = False) -> Column:
    """The colour at a position, between stops by parts, or of the last stop reached; of stops at one place the later wins;
    outside, the end colours."""
    stops = sorted(stops, key=lambda s: s[0])
    rgb = [parse_hex(c) for _, c in stops]
    out = F.lit(to_hex(rgb[0]))
    channel = lambda a, b, t: F.floor(a + (b - a) * t + 0.5).cast("int")
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))
    for (p0, _), (p1, _), a, b in zip(stops, stops[1:], rgb, rgb[1:]):
        if discrete or p1 == p0:
            inner = F.lit(to_hex(a))
        else:
            t = (position - p0) / (p1 - p0)
            inner = F.concat(F.lit("#"), *[hexed(channel(float(x), float(y), t)) for x, y in zip(a, b)])
        out = F.when(position >= p0, F.when(position >= p1, to_hex(b)).otherwise(inner)).otherwise(out)
    return out


def sample_ramp(stops: Stops, count: int) -> Column:
    """count evenly spaced colours as an array; one is the middle's."""
    at = [0.5] if count == 1 else [i / (count - 1) for i in range(count)]
    return F.array(*[colour_column(stops, F.lit(p)) for p in at])


def category_match(value: Column, table: dict[str, str], fallback: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), F.lit(fallback)) if pairs else F.lit(fallback)


def graduated(value: Column, breaks: list[float], colours: list[str], no_data: str | None = None) -> Column:
    """The colour of the number of breaks reached."""
    require(len(colours) == len(breaks) + 1, f"{len(breaks)} breaks need {len(breaks) + 1} colours, not {len(colours)}")
    k = F.aggregate(F.array(*[F.lit(float(b)) for b in breaks]), F.lit(0), lambda a, b: a + F.when(value >= b, 1).otherwise(0))
    return F.when(value.isNull(), no_data).otherwise(F.element_at(F.array(*map(F.lit, colours)), k + 1))


def rules(chain: list[tuple[Column, str]], fallback: str | None = None) -> Column:
    """The symbol of the first rule that holds."""
    out = None
    for condition, symbol in chain:
        out = F.when(condition, symbol) if out is None else out.when(condition, symbol)
    return F.lit(fallback) if out is None else out.otherwise(fallback)


def compile_symbology(symbology: dict, source: str) -> list[dict]:
    """Style layers of a symbology document: single, categorized, graduated, rules or raster."""
    kind, field = symbology.get("type"), symbology.get("field")
    base = {"source": source, "opacity": symbology.get("opacity", 1.0)}
    if kind == "single":
        return [base | {"id": f"{source}-single", "color": symbology["color"]}]
    if kind == "categorized":
        match = ["match", ["to-string", ["get", field]]]
        for c in symbology["categories"]:
            match += [str(c["value"]), c["color"]]
        return [base | {"id": f"{source}-categories", "color": [*match, symbology.get("fallback", "#999999")]}]
    if kind == "graduated":
        step: list = ["step", ["to-number", ["get", field]], symbology["colors"][0]]
        for b, c in zip(symbology["breaks"], symbology["colors"][1:], strict=True):
            step += [b, c]
        return [base | {"id": f"{source}-classes", "color": step}]
    if kind == "rules":
        return [base | {"id": f"{source}-rule-{i}", "filter": r["filter"], "color": r["color"], "minzoom": r.get("minzoom", 0), "maxzoom": r.get("maxzoom", 24)} for i, r in enumerate(symbology["rules"])]
    if kind == "raster":
        return [base | {"id": f"{source}-raster", "type": "raster", "rescale": symbology.get("range"), "palette": symbology.get("palette")}]
    raise ValueError(f"symbology {kind!r} is not one of single, categorized, graduated, rules, raster")


def read_palette(text: str, fmt: str) -> Stops:
    """Stops with positions from 0 to 1 of a clr, cpt, qgis (xml) or json palette."""
    stops: Stops = []
    if fmt == "json":
        stops = [(float(s["position"]), s["color"]) for s in json.loads(text)["stops"]]
    elif fmt == "qgis":
        for item in ET.fromstring(text).iter("item"):
            stops.append((float(item.get("value")), item.get("color")))
    else:
        require(fmt in ("clr", "cpt"), f"palette format {fmt!r} is not one of clr, cpt, qgis, json")
        for line in text.splitlines():
            part = line.split("#")[0].split()
            numbers = [float(p) for p in part if re.fullmatch(r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?", p)]
            if not part or len(numbers) != len(part):
                continue
            if fmt == "clr" and len(numbers) >= 4:
                stops.append((numbers[0], to_hex(tuple(numbers[1:4]))))
            elif fmt == "cpt" and len(numbers) == 8:
                stops += [(numbers[0], to_hex(tuple(numbers[1:4]))), (numbers[4], to_hex(tuple(numbers[5:8])))]
    require(len(stops) >= 2, "the palette has fewer than two stops")
    lo, hi = min(p for p, _ in stops), max(p for p, _ in stops)
    require(hi > lo, "all stops of the palette are at one position")
    out = []
    for p, c in stops:
        s = ((p - lo) / (hi - lo), c)
        if not out or out[-1] != s:
            out.append(s)
    return out


def write_palette(stops: Stops, fmt: str) -> str:
    if fmt == "json":
        return json.dumps({"stops": [{"position": p, "color": c} for p, c in stops]})
    if fmt == "clr":
        return "\n".join(["ColorMap 1 1", *(f"{p * 100:.6f} {' '.join(map(str, parse_hex(c)))}" for p, c in stops)]) + "\n"
    require(fmt == "cpt", f"palette format {fmt!r} can't be written; choose clr, cpt or json")
    line = lambda a, b: f"{a[0]:.6f} {' '.join(map(str, parse_hex(a[1])))} {b[0]:.6f} {' '.join(map(str, parse_hex(b[1])))}"
    return "\n".join(line(a, b) for a, b in zip(stops, stops[1:])) + "\n"


def class_label(breaks: list[float], i: int, unit: str = "") -> str:
    """Half-open labels of classes."""
    tail = f" {unit}" if unit else ""
    text = lambda v: f"{v:,.2f}".rstrip("0").rstrip(".")
    if i == 0:
        return f"< {text(breaks[0])}{tail}"
    if i == len(breaks):
        return f"≥ {text(breaks[-1])}{tail}"
    return f"{text(breaks[i - 1])} – {text(breaks[i])}{tail}"


def legend(symbology: dict, unit: str = "") -> list[tuple[str, str]]:
    """(label, colour) entries."""
    kind = symbology.get("type")
    if kind == "single":
        return [(symbology.get("label", "All"), symbology["color"])]
    if kind == "categorized":
        return [(str(c.get("label", c["value"])), c["color"]) for c in symbology["categories"]] + [("Other", symbology.get("fallback", "#999999"))]
    if kind == "graduated":
        return [(class_label(symbology["breaks"], i, unit), c) for i, c in enumerate(symbology["colors"])]
    return [(r.get("label", f"Rule {i + 1}"), r["color"]) for i, r in enumerate(symbology.get("rules", []))]


def pretty_ticks(low: float, high: float, count: int = 5) -> list[float]:
    """Multiples of the smallest round step that is at least the ideal one."""
    from ..operators.grids import nice_cell_size

    if high <= low:
        return [low]
    step = nice_cell_size((high - low) / count)
    return [k * step for k in range(math.ceil(low / step - 1e-9), math.floor(high / step + 1e-9) + 1)]


def rescale(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo)))


def redact_urls(c: Column) -> Column:
    """Without the values of token parameters."""
    return F.regexp_replace(c, r"([?&](?:token|sig|signature|access_token|key)=)[^&#\s\"']*", "$1***")


def clean(c: Column, most: int = 200) -> Column:
    """One line of at most `most` characters without control characters, markup escaped."""
    flat = F.trim(F.regexp_replace(c, r"[\p{Cntrl}\s]+", " "))
    safe = F.replace(F.replace(F.replace(flat, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.substring(safe, 1, most)


def level_label(v: Column, levels: list[float]) -> Column:
    """Whole numbers, or two decimals where any level has a fraction."""
    return F.format_string("%.2f" if any(x != int(x) for x in levels) else "%.0f", v)
