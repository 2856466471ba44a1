"""The composite scorer as a plain loop over rows, for comparison."""

import math
from collections import defaultdict, deque

import numpy as np

from lanternlog.functions import fixed


def base_signals(row):
    """The row's own signals, by a lookup of what the test messages contain."""
    out = {}
    weight = fixed.SEVERITY_WEIGHTS.get(row["level"])
    if weight:
        out["severity"] = weight
    for name in row["patterns"]:
        out[f"pattern:{name}"] = {n: w for n, _, w in fixed.PATTERNS}[name]
    if row["category"] and row["level"] in fixed.ERROR_LEVELS:
        out[f"structural:category:{row['category']}"] = 0.3
    return out


def combine(signals):
    groups = defaultdict(list)
    for name, weight in signals.items():
        head = name.split(":")[0]
        groups[{"zscore": "statistical"}.get(head, head)].append(weight)
    total = 0.0
    for group, share in fixed.CATEGORY_WEIGHTS.items():
        if groups[group]:
            total += max(groups[group]) * share
    score = min(round(total, 3), 1.0)
    if any(f"pattern:{n}" in signals for n in fixed.IMMEDIATE_PATTERNS):
        score = max(score, 0.65)
    return score


def simulate(rows):
    """rows: ordered dicts (ts in seconds, seq, tenant, service, level, template, patterns, category).

    Returns {seq: (mode, score, signals)} of all rows that are scored.
    """
    windows = defaultdict(lambda: deque(maxlen=30))
    last_emitted = {}
    occurrences = defaultdict(int)
    erring = defaultdict(list)
    for r in rows:
        if r["level"] in fixed.ERROR_LEVELS:
            erring[r["tenant"]].append((math.floor(r["ts"]), r["service"]))
    out = {}
    for r in rows:
        ts, second = r["ts"], math.floor(r["ts"])
        error = r["level"] in fixed.ERROR_LEVELS
        window = windows[(r["tenant"], r["service"])]
        start = int(ts // 10) * 10
        if not window or window[-1][0] != start:
            window.append([start, 0, 0])
        window[-1][1] += 1
        window[-1][2] += int(error)
        while window[0][0] < ts - 300:
            window.popleft()
        signals = base_signals(r)
        patterns = {k: v for k, v in signals.items() if k.startswith("pattern:")}
        dying = any(p in fixed.IMMEDIATE_PATTERNS for p in r["patterns"])
        fatal = signals.get("severity", 0) >= 0.95 and patterns and max(patterns.values()) >= 0.5
        if dying or fatal:
            top = max(patterns.items(), key=lambda x: x[1])[0]
            key = (r["tenant"], r["service"], top)
            if key not in last_emitted or second - last_emitted[key] >= 300:
                last_emitted[key] = second
                out[r["seq"]] = ("immediate", combine(signals), signals)
                continue
        if len(window) < 3:
            continue
        rates = np.array([e / n for _, n, e in window])
        mean, std = rates.mean(), rates.std()
        if std < 1e-9:
            if mean >= 0.5:
                signals["zscore:sustained_failure"] = min(mean * 2, 1.0)
            elif mean >= 0.1:
                signals["zscore:elevated_baseline"] = mean
        else:
            z = (rates[-1] - mean) / std
            if round(z, 9) >= 2.0:
                signals["zscore:spike"] = min(z / 5, 1.0)
        if error:
            near = {s for t, s in erring[r["tenant"]] if second - 300 <= t <= second}
            blast = 0.9 if len(near) >= 5 else 0.6 if len(near) >= 3 else 0.3 if len(near) >= 2 else 0
            if blast:
                signals["context:blast_radius"] = blast
            before = [e for _, _, e in list(window)[:-1]]
            average, now = sum(before) / len(before), window[-1][2]
            if average < 1:
                speed = 0.8 if now >= 10 else 0.6 if now >= 5 else 0.4 if now >= 2 else 0
            else:
                ratio = now / average
                speed = 0.8 if ratio >= 5 else 0.5 if ratio >= 3 else 0.3 if ratio >= 2 else 0
            if speed:
                signals["context:velocity"] = speed
            occurrences[(r["tenant"], r["template"])] += 1
            seen = occurrences[(r["tenant"], r["template"])]
            if seen <= 5:
                signals["context:recurrence"] = 0.3 if seen == 1 else 0.1
        out[r["seq"]] = ("windowed", combine(signals), signals)
    return out
