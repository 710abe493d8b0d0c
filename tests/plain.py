"""Plain versions that the tests compare with."""

from collections.abc import Iterable


def expand(frames: list[dict], margin: float = 0.25, max_gap: float = 0.5, max_extension: float = 2.0, symmetric: bool = False) -> Iterable[dict]:
    """Walks an event's bounds outwards while its pair stays close.

    frames: (ts, gap or null, start_s, end_s, duration) of one event, by ts. Backwards, the limit is
    measured from the start as it moves, forwards from the given end; `symmetric` measures both from
    the given bounds. Unsupported frames count up to `max_gap` past the last supported one.
    """
    times = [f["ts"] for f in frames]
    close = [f["gap"] is not None and f["gap"] == f["gap"] and f["gap"] <= margin for f in frames]
    first, end, duration = frames[0]["start_s"], frames[0]["end_s"], frames[0]["duration"]
    near = lambda t: min(range(len(times)), key=lambda i: (abs(times[i] - t), times[i]))
    start = support = first
    for i in range(near(first) - 1, -1, -1):
        if (first if symmetric else start) - times[i] > max_extension + 1e-9:
            break
        if close[i]:
            start = support = times[i]
        elif support - times[i] <= max_gap + 1e-9:
            start = times[i]
        else:
            break
    until, support = end, end
    for i in range(near(end) + 1, len(times)):
        if times[i] - end > max_extension + 1e-9:
            break
        after = times[i + 1] if i + 1 < len(times) else duration
        if close[i]:
            support, until = times[i], min(after, duration)
        elif times[i] - support <= max_gap + 1e-9:
            until = min(after, duration)
        else:
            break
    row = {k: v for k, v in frames[0].items() if k not in ("ts", "gap")}
    return [row | {"start_s": max(0.0, start), "end_s": min(duration, max(until, start + 1e-6))}]


def keep(nearby: list[dict], max_gap: float, switch_margin: float, hold: bool) -> Iterable[int]:
    """Which of the rows (at, vehicle, rank, ordered) a person is given, frame after frame."""
    last = since = None
    for at in sorted({r["at"] for r in nearby}):
        frame = [(i, r) for i, r in enumerate(nearby) if r["at"] == at]
        chosen = frame[0]
        if last is not None and at - since <= max_gap + 1e-9:
            same = [x for x in frame if x[1]["vehicle"] == last]
            if same and same[0][1]["rank"] <= chosen[1]["rank"] + switch_margin:
                chosen = same[0]
            elif not same and hold:
                continue
        last, since = chosen[1]["vehicle"], at
        yield chosen[0]
