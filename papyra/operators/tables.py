"""Tables of a page: grids of ruling lines first, then text that lines up in columns.

Works on the words and rules of one page, which is never split. A table is (box, rows of cell texts, how it was
found). Reading order inside a cell is that of its lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import mean

import numpy as np

from ..sources.pdf import Layout, Word
from ..sources.pdf_text import line_text, lines_of

# Fixed values, in points: how near rules touch, edges and column gaps are taken as one, a dip between columns is wide,
# cells line up, and a line covers a column.
TOUCH, EDGE, SAME_COLUMN, DIP, ALIGNED, COVERS = 2.0, 2.0, 2.0, 3.0, 2.0, 1.0
# Fixed values, in font sizes: a gap between cells, between two columns set close, lines of one table, lines that need
# to line up, a wrapped line, its indent, and the least pitch of lines.
CELL_GAP, CLOSE_COLUMNS, NEAR, REACH, WRAPPED, INDENT, LEAST_PITCH = 0.9, 0.5, 2.5, 6.0, 1.6, 0.4, 0.8
# Fixed values, in pitches: closer than rows are, staggered lines of one row, and the room between two rows.
TIGHTER, STAGGERED, ROOM = 0.93, 0.75, 1.2
#: Lines with one cell that a table may hold in a row, and words that make a cell prose.
LOOK_AHEAD, PROSE_WORDS = 2, 6


@dataclass
class Table:
    """A table: its box, its cells row by row, and ``lines`` or ``alignment``."""

    box: list[float]
    rows: list[list[str]]
    method: str


@dataclass
class Cell:
    """Words that stand together on one line, or in one column of a row."""

    words: list[Word] = field(default_factory=list)

    @property
    def x0(self) -> float:
        return self.words[0].x0

    @property
    def x1(self) -> float:
        return self.words[-1].x1

    @property
    def first(self) -> str:
        return self.words[0].text[:1]

    def __bool__(self) -> bool:
        return bool(self.words)

    def has_letters(self) -> bool:
        return any(c.isalpha() for w in self.words for c in w.text)


Row = list[Cell]


def _middle(line: Row) -> float:
    w = line[0].words[0]
    return (w.y0 + w.y1) / 2


def _size(line: Row) -> float:
    return line[0].words[0].size


def _filled(row: Row) -> int:
    return sum(map(bool, row))


def clusters(values: list[float], tolerance: float = EDGE) -> list[float]:
    """Means of sorted values, each joining the last cluster while it is within tolerance of its running mean."""
    groups: list[list[float]] = []
    for v in sorted(values):
        if groups and v - mean(groups[-1]) <= tolerance:
            groups[-1].append(v)
        else:
            groups.append([v])
    return [mean(g) for g in groups]


def rule_groups(rules: list[tuple[bool, float, float, float]]) -> list[list[int]]:
    """Rules that touch, directly or by way of others: a search that meets all rules not reached yet at once."""
    if not rules:
        return []
    across, at, a, b = (np.array(x) for x in zip(*rules))
    left = np.ones(len(rules), bool)
    groups = []
    for seed in range(len(rules)):
        if not left[seed]:
            continue
        left[seed], todo, group = False, [seed], []
        while todo:
            k = todo.pop()
            group.append(k)
            overlap = (a <= b[k] + TOUCH) & (a[k] <= b + TOUCH)
            along = (across == across[k]) & (np.abs(at - at[k]) < TOUCH) & overlap
            cross = (across != across[k]) & (at >= a[k] - TOUCH) & (at <= b[k] + TOUCH) & (at[k] >= a - TOUCH) & (at[k] <= b + TOUCH)
            found = np.flatnonzero((along | cross) & left)
            left[found] = False
            todo += found.tolist()
        groups.append(sorted(group))
    return groups


def ruled_tables(page: Layout) -> list[Table]:
    """Tables whose cells are drawn with ruling lines; a word belongs to the cell that holds its centre."""
    out = []
    for group in rule_groups(page.rules):
        own = [page.rules[k] for k in group]
        xs, ys = (np.array(clusters([r[1] for r in own if r[0] == flat])) for flat in (False, True))
        if len(xs) < 2 or len(ys) < 2 or (len(xs) - 1) * (len(ys) - 1) < 2:
            continue
        cells: dict[tuple[int, int], list[Word]] = {}
        for w in page.words:
            column, row = (int(np.searchsorted(edges, v, side="right")) - 1 for edges, v in ((xs, (w.x0 + w.x1) / 2), (ys, (w.y0 + w.y1) / 2)))
            if 0 <= column < len(xs) - 1 and 0 <= row < len(ys) - 1:
                cells.setdefault((row, column), []).append(w)
        if cells:
            text = lambda k: " ".join(map(line_text, lines_of(cells.get(k, []))))  # noqa: E731, B023
            rows = [[text((r, c)) for c in range(len(xs) - 1)] for r in range(len(ys) - 1)]
            out.append(Table([float(xs[0]), float(ys[0]), float(xs[-1]), float(ys[-1])], rows, "lines"))
    return out


def cells_of(line: list[Word]) -> Row:
    """The words of a line as cells: a gap wider than a generous space begins a new one."""
    out: Row = []
    for w in line:
        if out and w.x0 - out[-1].words[-1].x1 < CELL_GAP * out[-1].words[-1].size:
            out[-1].words.append(w)
        else:
            out.append(Cell([w]))
    return out


def has_leaders(line: Row) -> bool:
    """Whether a row of dots runs from a title to its page number."""
    texts = [w.text for cell in line for w in cell.words]
    return sum(len(t) for t in texts if set(t) <= set(".·…")) >= 4 or any("...." in t for t in texts)


def column_spans(rows: list[Row]) -> list[tuple[float, float]]:
    """The stretches of x that hold a column each.

    Coverage is counted once for every stretch between two edges of cells. Columns part where nothing covers more than
    a hair's breadth, and where only a few rows cover a dip that has busier stretches on both sides inside the same
    covered run: a heading across two columns does not join them.
    """
    spans = np.array([(c.x0, c.x1) for row in rows for c in row])
    edges = np.unique(spans)
    if len(edges) == 1:
        return [(float(edges[0]), float(edges[0]))]
    middles = (edges[1:] + edges[:-1]) / 2
    starts, stops = np.sort(spans[:, 0]), np.sort(spans[:, 1])
    over = np.searchsorted(starts, middles, side="right") - np.searchsorted(stops, middles, side="left")
    allowed = max(1, len(rows) * 15 // 100) if len(rows) >= 4 else 0
    gaps = [k for k in np.flatnonzero(over == 0) if edges[k + 1] - edges[k] > SAME_COLUMN]
    out: list[tuple[float, float]] = []
    begin = 0
    for gap in [*gaps, len(over)]:
        run = range(begin, int(gap))
        busy = [k for k in run if over[k] > allowed]
        at = float(edges[begin])
        for left, right in zip(busy, busy[1:]) if allowed else ():
            if right > left + 1 and edges[right] - edges[left + 1] >= DIP:
                out.append((at, float(edges[left + 1])))
                at = float(edges[right])
        out.append((at, float(edges[int(gap)])))
        begin = int(gap) + 1
    return out


def into_columns(line: Row, columns: list[tuple[float, float]]) -> Row:
    """The words of a line by columns. A run of words goes to one column, unless a change of column inside it goes
    with more room than a space takes."""

    def best(x0: float, x1: float) -> int:
        shares = [min(x1, c[1]) - max(x0, c[0]) for c in columns]
        top = max(shares)
        return len(shares) - 1 - shares[::-1].index(top)

    out = [Cell() for _ in columns]
    for cell in line:
        of = [best(w.x0, w.x1) for w in cell.words]
        parts = any(a != b and q.x0 - p.x1 > CLOSE_COLUMNS * p.size for a, b, p, q in zip(of, of[1:], cell.words, cell.words[1:]))
        for k, w in zip(of if parts else [best(cell.x0, cell.x1)] * len(of), cell.words):
            out[k].words.append(w)
    return out


def continues(above: Row, row: Row, tighter: bool) -> bool:
    """Whether a line goes on with the row above it instead of starting one; ``tighter`` than rows of the table stand."""
    if not row[0]:
        over = all(upper or not cell for cell, upper in zip(row, above))
        # The same cells filled beyond the first is a row like the one above, unless it reads on in small letters.
        same = all(bool(cell) == bool(upper) for cell, upper in zip(row[1:], above[1:]))
        reads_on = next((c.first for c in row if c), "").islower()
        is_row = _filled(row) >= 2 and same and (not above[0] or not reads_on)
        return over and not is_row and any(cell and cell.has_letters() for cell in row)
    # A label alone, all of it words, and a line that reads on: the figures stand on the label's last line.
    alone = above[0] and _filled(above) == 1 and all(any(c.isalpha() for c in w.text) for w in above[0].words)
    if not alone:
        return False
    return row[0].first.islower() or tighter and row[0].x0 - above[0].x0 >= INDENT * row[0].words[0].size


def bands(lines: list[Row], columns: list[tuple[float, float]]) -> list[list[Row]] | None:
    """Lines by rows where cells are centred on rows of several lines; none for a block that is not set so.

    Such a block has lines closer together than those of any one cell, in different columns, and room between rows.
    """
    filled = np.array([[bool(c) for c in into_columns(line, columns)] for line in lines])
    at = np.array([_middle(line) for line in lines])
    steps = [d for k in range(len(columns)) for d in np.diff(at[filled[:, k]]) if d > LEAST_PITCH * _size(lines[0])]
    if not steps:
        return None
    pitch, gaps = min(steps), np.diff(at)
    apart = ~(filled[1:] & filled[:-1]).any(axis=1)
    if not (apart & (gaps <= STAGGERED * pitch)).any():
        return None
    cuts = [0, *(np.flatnonzero(gaps > ROOM * pitch) + 1).tolist(), len(lines)]
    return [lines[a:b] for a, b in zip(cuts, cuts[1:])] if len(cuts) > 3 else None


def is_prose(rows: list[Row]) -> bool:
    """Two columns of running text: most cells on both sides are whole lines of it."""
    if not rows or len(rows[0]) != 2:
        return False
    for side in zip(*rows):
        cells = [c for c in side if c]
        long = sum(sum(w.text.count(" ") + 1 for w in c.words) >= PROSE_WORDS for c in cells)
        if not cells or 2 * long <= len(cells):
            return False
    return True


def is_list(rows: list[Row]) -> bool:
    """Items with a number, a letter or a bullet in front."""

    def marker(cell: Cell) -> bool:
        if len(cell.words) != 1:
            return False
        text = cell.words[0].text
        bare = text.rstrip(".):")
        return text in ("•", "-", "–", "*", "▪") or len(bare) < len(text) and len(bare) <= 3 and (not bare or bare.isalnum())

    firsts = [row[0] for row in rows if row[0]]
    return all(len(row) == 2 for row in rows) and bool(firsts) and all(map(marker, firsts))


def _merge(target: Row, more: Row) -> None:
    for cell, extra in zip(target, more):
        cell.words += extra.words


def block_rows(lines: list[Row], columns: list[tuple[float, float]]) -> list[Row]:
    """The rows of a block: by bands, else line by line with wrapped cells joined."""
    rows: list[Row] = []
    if (grouped := bands(lines, columns)) is not None:
        for group in grouped:
            rows.append([Cell() for _ in columns])
            for line in group:
                _merge(rows[-1], into_columns(line, columns))
        return rows
    at = [_middle(line) for line in lines]
    gaps = [b - a for a, b in zip(at, at[1:])]
    pitch = sorted(gaps)[len(gaps) // 2] if gaps else 0.0
    for line, gap in zip(lines, [0.0, *gaps]):
        row = into_columns(line, columns)
        if rows and gap <= WRAPPED * _size(line) and continues(rows[-1], row, gap <= TIGHTER * pitch):
            _merge(rows[-1], row)
        else:
            rows.append(row)
    return rows


def block_tables(lines: list[Row]) -> Iterator[Table]:
    """The table of a block of lines, or those of its parts where a line of running text cuts through it."""
    todo = [lines]
    while todo:
        block = todo.pop()
        wide = [line for line in block if len(line) > 1]
        columns = column_spans(wide) if len(wide) > 1 else []
        if len(columns) < 2:
            continue
        crosses = lambda line: len(line) == 1 and sum(min(line[0].x1, c[1]) - max(line[0].x0, c[0]) > COVERS for c in columns) > 1  # noqa: E731, B023
        cut = next((k for k, line in enumerate(block) if crosses(line)), None)
        if cut is not None:
            todo += [block[cut + 1 :], block[:cut]]
            continue
        if 2 * sum(map(has_leaders, block)) >= len(block):
            continue
        rows = block_rows(block, columns)
        if is_prose(rows) or is_list(rows):
            continue
        # A single label under the table was taken on trial.
        if len(block[-1]) == 1 and len(rows) > 1 and rows[-1][0] and _filled(rows[-1]) == 1:
            rows.pop()
        if len(rows) > 1:
            words = [w for row in rows for c in row for w in c.words]
            box = [min(w.x0 for w in words), min(w.y0 for w in words), max(w.x1 for w in words), max(w.y1 for w in words)]
            yield Table(box, [[line_text(c.words) for c in row] for row in rows], "alignment")


def _lined_up(known: list[Row], line: Row) -> bool:
    """Whether two cells or more, and half of them, begin, end or are centred where cells before them are."""
    marks = lambda c: np.array([c.x0, c.x1, (c.x0 + c.x1) / 2])
    seen = np.array([marks(c) for row in known for c in row])
    hits = sum(bool((np.abs(seen - marks(c)) < ALIGNED).any()) for c in line)
    return hits >= 2 and 2 * hits >= len(line)


def aligned_tables(page: Layout, taken: list[list[float]]) -> list[Table]:
    """Tables found from text that lines up; words inside the boxes that are taken are left out."""

    def free(w: Word) -> bool:
        x, y = (w.x0 + w.x1) / 2, (w.y0 + w.y1) / 2
        return not any(b[0] <= x <= b[2] and b[1] <= y <= b[3] for b in taken)

    lines = [cells_of(line) for line in lines_of([w for w in page.words if free(w)])]
    within = lambda k, sizes: _middle(lines[k]) - _middle(lines[k - 1]) <= sizes * _size(lines[k])
    out: list[Table] = []
    start = 0
    while start < len(lines):
        if len(lines[start]) < 2:
            start += 1
            continue
        end = start + 1
        while True:
            # The next line of several cells, past single pieces that may sit inside the table.
            after = next((k for k in range(end, min(len(lines), end + LOOK_AHEAD + 1)) if len(lines[k]) > 1), None)
            if after is None:
                break
            steps = range(end, after + 1)
            # A line that follows at once belongs to the table however far it is.
            if not (after == end or all(within(k, NEAR) for k in steps) or all(within(k, REACH) for k in steps) and _lined_up(lines[start:end], lines[after])):
                break
            end = after + 1
        trailing = end < len(lines) and len(lines[end]) == 1 and within(end, NEAR)
        out += block_tables(lines[start : end + trailing])
        start = end
    return out


def tables_on(page: Layout) -> list[Table]:
    """All tables of a page from top to bottom, then from left to right."""
    ruled = ruled_tables(page)
    return sorted(ruled + aligned_tables(page, [t.box for t in ruled]), key=lambda t: (t.box[1], t.box[0]))
