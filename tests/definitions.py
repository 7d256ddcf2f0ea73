"""Definitions of single results, on small inputs, for the tests to compare with."""
import re
from decimal import Decimal, localcontext

import numpy as np

NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)")


def product(text, mult):
    with localcontext() as c:
        c.prec = 400
        return str(Decimal(text) * Decimal(mult))


def carried(statuses):
    """Whether each table of a file takes the last sheet unit.

    The letters before a table are rewritten until nothing changes: an N takes
    an F beside it away, has no effect beside a U or at the start; what then
    stands last decides."""
    out = []
    for i, status in enumerate(statuses):
        left, before = "".join(statuses[:i]), None
        while left != before:
            before, left = left, re.sub("^N", "", left.replace("FN", "").replace("UN", "U"))
        out.append(status == "N" and left.endswith("U"))
    return out


def line_multiplier(grid, rules, r, c):
    """The multiplier of a number: of the topmost unit above it, else of the leftmost one before it."""
    def units(texts):
        return [next(m for k, m in rules if t.endswith(k)) for t in texts if t and any(t.endswith(k) for k, _ in rules)]
    if grid[r][c] is None or not NUMBER.fullmatch(grid[r][c]):
        return None
    found = units([row[c] for row in grid[:r]]) or units(grid[r][:c])
    return found[0] if found else None


def split_scores(counted, hit_data, hit_rest, macro):
    """The score of every (row, column) split: how much of the data region and of the rest is hit."""
    rows, cols = counted.shape
    scores = np.full((min(11, rows), min(11, cols)), 0.0)
    for at in np.ndindex(scores.shape):
        inside = np.zeros(counted.shape, bool)
        inside[at[0]:, at[1]:] = True
        n_in, n_out = (counted & inside).sum(), (counted & ~inside).sum()
        h_in, h_out = hit_data[counted & inside].sum(), hit_rest[counted & ~inside].sum()
        if n_in and n_out:
            scores[at] = (float(h_out) / n_out + float(h_in) / n_in) / 2 if macro else float(h_out + h_in) / (n_out + n_in)
    return scores
