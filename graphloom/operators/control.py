"""Small driver-side helpers: arguments, configurations, run plans and reports."""

from __future__ import annotations

from collections.abc import Sequence


def parse_thresholds(text: str) -> list[float]:
    """first:last:step with both ends, or values between commas."""
    if ":" not in text:
        return [float(x) for x in text.split(",") if x.strip()]
    first, last, step = map(float, text.split(":"))
    if step <= 0 or last < first:
        raise ValueError("first:last:step needs a positive step and a last value that is not below the first")
    return [round(first + i * step, 6) for i in range(round((last - first) / step) + 1)]


def merged(*configs: dict) -> dict:
    """Settings of several sources, nested ones too; the last that names one counts."""
    out: dict = {}
    for config in configs:
        for key, value in config.items():
            both = isinstance(value, dict) and isinstance(out.get(key), dict)
            out[key] = merged(out[key], value) if both else value
    return out


def hub_path(uri: str, scheme: str = "hf://") -> tuple[str, str]:
    """(owner/name, path inside) of a hub address."""
    owner, name, *inside = uri.removeprefix(scheme).strip("/").split("/")
    if not uri.startswith(scheme) or not owner or not name:
        raise ValueError(f"not an address of the form {scheme}owner/name/path: {uri!r}")
    return f"{owner}/{name}", "/".join(inside)


def stop_ids(*groups: Sequence[int] | int | None) -> list[int]:
    """Ids in order of their first mention; none at all, or a negative one, fails."""
    flat = [x for g in groups if g is not None for x in ([g] if isinstance(g, int) else g)]
    out = list(dict.fromkeys(flat))
    if not out or min(out) < 0:
        raise ValueError("stop ids are missing or negative")
    return out


# Columns of the report and their formats.
REPORT = (
    ("threshold", "threshold", 9, ".2f"), ("precision", "prec", 6, ".1f"), ("recall", "recall", 6, ".1f"), ("f1", "F1", 6, ".1f"),
    ("extra_per_question", "extra/q", 8, ".2f"), ("missing_pct", "miss%", 6, ".1f"), ("exact_pct", "exact%", 7, ".1f"),
)


def report(rows: Sequence[dict]) -> str:
    """A table of fixed widths from rows of a threshold sweep."""
    lines = [" ".join(f"{title:>{width}}" for _, title, width, _ in REPORT)]
    for r in rows:
        cells = [r[name] if isinstance(r[name], str) else format(r[name], how) for name, _, _, how in REPORT]
        lines.append(" ".join(f"{cell:>{width}}" for cell, (_, _, width, _) in zip(cells, REPORT)))
    return "\n".join(lines)
