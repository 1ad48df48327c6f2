"""Zone names and zone abbreviations as a fixed-size lookup.

The table has one entry per IANA zone (about 600, whatever the data size): the abbreviations the zone
uses between 2000 and 2037 with their offset in seconds.  An abbreviation such as ``CST`` has a
different offset in different zones, therefore it is always looked up inside one zone.
"""

from __future__ import annotations

import json
import zoneinfo
from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

_ROWS: list[tuple[str, dict[str, int]]] = []


def _rows() -> list[tuple[str, dict[str, int]]]:
    if not _ROWS:
        probes = [datetime(y, m, 1, tzinfo=timezone.utc) for y in range(2000, 2038) for m in (1, 4, 7, 10)]
        for name in sorted(zoneinfo.available_timezones()):
            if name in ("Factory", "localtime") or name.startswith(("posix/", "right/", "build/")):
                continue
            zone = zoneinfo.ZoneInfo(name)
            found: dict[str, int] = {}
            for p in probes:
                local = p.astimezone(zone)
                label = local.tzname()
                if label and label.isalpha():
                    found[label] = int(local.utcoffset().total_seconds())
            _ROWS.append((name, found))
    return _ROWS


def zone_names() -> list[str]:
    return [name for name, _ in _rows()]


def abbreviations_of(zone: Column) -> Column:
    """The abbreviation map of a zone name; null where the name is no known zone.

    The whole lookup is one folded map literal, so no join and no rows travel for it.
    """
    lookup = F.from_json(F.lit(json.dumps(dict(_rows()))), "map<string,map<string,int>>")
    return F.element_at(lookup, zone)


def unambiguous_abbreviations() -> dict[str, int]:
    """Abbreviations with one offset in all zones that use them."""
    seen: dict[str, set[int]] = {}
    for _, found in _rows():
        for label, offset in found.items():
            seen.setdefault(label, set()).add(offset)
    return {label: next(iter(v)) for label, v in seen.items() if len(v) == 1}
