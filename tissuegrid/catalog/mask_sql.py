"""SQL texts for mask steps, chained as common table expressions."""

from __future__ import annotations


class Steps:
    """Collects CTEs; every method adds one step and returns its name."""

    def __init__(self, *tables: str):
        self.parts = list(tables)
        self.n = 0

    def add(self, body: str, head: str = "") -> str:
        self.n += 1
        name = f"s{self.n}"
        self.parts.append(f"{name}{head} AS MATERIALIZED ({body})" if not head else f"{name}{head} AS ({body})")
        return name

    def text(self, body: str) -> str:
        return "WITH RECURSIVE " + ",\n".join(self.parts) + "\n" + body

    def _window(self, src: str, fn: str, before: int, after: int) -> str:
        line = self.add(
            f"SELECT slide_id, r, c, {fn}(v) OVER (PARTITION BY slide_id, r ORDER BY c "
            f"RANGE BETWEEN {before} PRECEDING AND {after} FOLLOWING) AS v FROM {src}"
        )
        return self.add(
            f"SELECT slide_id, r, c, {fn}(v) OVER (PARTITION BY slide_id, c ORDER BY r "
            f"RANGE BETWEEN {before} PRECEDING AND {after} FOLLOWING) AS v FROM {line}"
        )

    def erode(self, src: str, k: int) -> str:
        return self._window(src, "min", k // 2, k - 1 - k // 2)

    def dilate(self, src: str, k: int) -> str:
        return self._window(src, "max", k - 1 - k // 2, k // 2)

    def opening(self, src: str, k: int) -> str:
        return self.dilate(self.erode(src, k), k)

    def closing(self, src: str, k: int) -> str:
        return self.erode(self.dilate(src, k), k)

    def runs(self, cells: str, conn: int) -> str:
        """Runs with ``lab``, the code of the first cell of their component."""
        d = 1 if conn == 8 else 0
        runs = self.add(
            "SELECT slide_id, r, min(c) AS c0, max(c) AS c1, CAST(r AS BIGINT) * 100000 + min(c) AS rid FROM "
            f"(SELECT slide_id, r, c, c - row_number() OVER (PARTITION BY slide_id, r ORDER BY c) AS g FROM {cells}) t "
            "GROUP BY slide_id, r, g"
        )
        down = self.add(
            f"SELECT a.slide_id, a.rid AS x, b.rid AS y FROM {runs} a JOIN {runs} b ON a.slide_id = b.slide_id "
            f"AND b.r = a.r + 1 AND b.c0 <= a.c1 + {d} AND b.c1 >= a.c0 - {d}"
        )
        edges = self.add(f"SELECT slide_id, x, y FROM {down} UNION SELECT slide_id, y, x FROM {down}")
        self.n += 1
        reach = f"s{self.n}"
        self.parts.append(
            f"{reach}(slide_id, rid, lab) AS (SELECT slide_id, rid, rid FROM {runs} UNION "
            f"SELECT q.slide_id, e.y, q.lab FROM {reach} q JOIN {edges} e ON e.slide_id = q.slide_id AND e.x = q.rid)"
        )
        least = self.add(f"SELECT slide_id, rid, min(lab) AS lab FROM {reach} GROUP BY slide_id, rid")
        return self.add(
            f"SELECT n.slide_id, n.r, n.c0, n.c1, l.lab FROM {runs} n JOIN {least} l "
            "ON l.slide_id = n.slide_id AND l.rid = n.rid"
        )

    def boxes(self, runs: str) -> str:
        return self.add(
            "SELECT slide_id, lab, CAST(row_number() OVER (PARTITION BY slide_id ORDER BY lab) - 1 AS INT) AS region_id, "
            "min(r) AS r0, CAST(min(c0) AS INT) AS c0, max(r) + 1 AS r1, CAST(max(c1) + 1 AS INT) AS c1, "
            f"CAST(sum(c1 - c0 + 1) AS BIGINT) AS area FROM {runs} GROUP BY slide_id, lab"
        )

    def fill(self, src: str) -> str:
        empty = self.add(f"SELECT slide_id, r, c FROM {src} WHERE v = 0")
        runs = self.runs(empty, 4)
        boxes = self.boxes(runs)
        shape = self.shape(src)
        inner = self.add(
            f"SELECT b.slide_id, b.lab FROM {boxes} b JOIN {shape} z ON z.slide_id = b.slide_id "
            "WHERE b.r0 > 0 AND b.c0 > 0 AND b.r1 < z.h AND b.c1 < z.w"
        )
        holes = self.add(
            f"SELECT n.slide_id, n.r, unnest(range(n.c0, n.c1 + 1)) AS c FROM {runs} n JOIN {inner} i "
            "ON i.slide_id = n.slide_id AND i.lab = n.lab"
        )
        return self.add(
            f"SELECT m.slide_id, m.r, m.c, CASE WHEN o.c IS NOT NULL THEN 1 ELSE m.v END AS v FROM {src} m "
            f"LEFT JOIN {holes} o ON o.slide_id = m.slide_id AND o.r = m.r AND o.c = m.c"
        )

    def shape(self, src: str) -> str:
        return self.add(f"SELECT slide_id, max(r) + 1 AS h, max(c) + 1 AS w FROM {src} GROUP BY slide_id")

    def bars(self, src: str, wr: float, hr: float) -> str:
        on = self.add(f"SELECT slide_id, r, c FROM {src} WHERE v = 1")
        runs = self.runs(on, 8)
        boxes = self.boxes(runs)
        shape = self.shape(src)
        bad = self.add(
            f"SELECT b.slide_id, b.lab FROM {boxes} b JOIN {shape} z ON z.slide_id = b.slide_id WHERE "
            f"(b.c1 - b.c0 > {wr} * z.w AND b.r1 - b.r0 < {1 - hr} * z.h) OR "
            f"(b.r1 - b.r0 > {hr} * z.h AND b.c1 - b.c0 < {1 - wr} * z.w)"
        )
        gone = self.add(
            f"SELECT n.slide_id, n.r, unnest(range(n.c0, n.c1 + 1)) AS c FROM {runs} n JOIN {bad} i "
            "ON i.slide_id = n.slide_id AND i.lab = n.lab"
        )
        return self.add(
            f"SELECT m.slide_id, m.r, m.c, CASE WHEN o.c IS NOT NULL THEN 0 ELSE m.v END AS v FROM {src} m "
            f"LEFT JOIN {gone} o ON o.slide_id = m.slide_id AND o.r = m.r AND o.c = m.c"
        )

    def margin_rows(self, src: str, m: int) -> str:
        shape = self.shape(src)
        return self.add(
            f"SELECT m.slide_id, m.r, m.c, CASE WHEN m.r = {m} OR m.r = z.h - {m} THEN 0 ELSE m.v END AS v "
            f"FROM {src} m JOIN {shape} z ON z.slide_id = m.slide_id"
        )

    def full_sides(self, src: str, m: int) -> str:
        """One side after the other, each test on the mask the previous one left."""
        for line, zone, length in (
            ("r = 0", f"r < {m}", "w"),
            ("r = h - 1", f"r >= h - {m}", "w"),
            ("c = 0", f"c < {m}", "h"),
            ("c = w - 1", f"c >= w - {m}", "h"),
        ):
            shape = self.shape(src)
            sized = self.add(
                f"SELECT m.slide_id, m.r, m.c, m.v, z.h, z.w FROM {src} m JOIN {shape} z ON z.slide_id = m.slide_id"
            )
            full = self.add(
                f"SELECT slide_id FROM {sized} GROUP BY slide_id, h, w "
                f"HAVING sum(CASE WHEN {line} THEN v ELSE 0 END) >= 0.9 * {length}"
            )
            src = self.add(
                f"SELECT slide_id, r, c, CASE WHEN {zone} AND slide_id IN (SELECT slide_id FROM {full}) THEN 0 "
                f"ELSE v END AS v FROM {sized}"
            )
        return src

    def clean(self, src: str, opening: int, fill: int, dilation: int, m: int, wr: float, hr: float) -> str:
        src = self.margin_rows(self.fill(self.opening(src, opening)), m)
        src = self.bars(src, wr, hr)
        src = self.fill(self.closing(src, fill))
        src = self.dilate(src, dilation)
        return self.full_sides(self.opening(src, opening * 4), m)
