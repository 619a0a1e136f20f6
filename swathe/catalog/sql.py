"""SQL fragments shared by the checks."""

# Local frames of the path segments, from the view ``path``.
SEGMENTS = """
vtx AS (SELECT run, k, lx, ly, lz, rx, ry, rz, (lx+rx)/2 AS cx, (ly+ry)/2 AS cy, (lz+rz)/2 AS cz,
  lead((lx+rx)/2) OVER w AS nx, lead((ly+ry)/2) OVER w AS ny, lead((lz+rz)/2) OVER w AS nz
  FROM path WINDOW w AS (PARTITION BY run ORDER BY k)),
sg1 AS (SELECT *, sqrt((nx-cx)*(nx-cx)+(ny-cy)*(ny-cy)+(nz-cz)*(nz-cz)) AS len FROM vtx WHERE nx IS NOT NULL),
sg2 AS (SELECT *, (nx-cx)/len AS fx, (ny-cy)/len AS fy, (nz-cz)/len AS fz FROM sg1),
sg3 AS (SELECT *, (rx-lx)*fx+(ry-ly)*fy+(rz-lz)*fz AS dd FROM sg2),
sg4 AS (SELECT *, rx-lx-fx*dd AS ax, ry-ly-fy*dd AS ay, rz-lz-fz*dd AS az FROM sg3),
sg5 AS (SELECT *, sqrt(ax*ax+ay*ay+az*az) AS an FROM sg4),
sg6 AS (SELECT *, ax/an AS qx, ay/an AS qy, az/an AS qz FROM sg5),
sg7 AS (SELECT *, fy*qz-fz*qy AS ux0, fz*qx-fx*qz AS uy0, fx*qy-fy*qx AS uz0 FROM sg6),
seg AS (SELECT run, k, cx, cy, cz, fx, fy, fz, qx, qy, qz, len,
  CASE WHEN uz0 < 0 THEN -ux0 ELSE ux0 END AS ux, CASE WHEN uz0 < 0 THEN -uy0 ELSE uy0 END AS uy,
  CASE WHEN uz0 < 0 THEN -uz0 ELSE uz0 END AS uz FROM sg7)"""

# Points inside the envelope with their first segment; the range on y only narrows the join.
HITS = SEGMENTS + """,
mm AS (SELECT p.run, p.frame, p.point_idx, s.k, p.x, p.y, p.z, len,
  (p.x-cx)*fx+(p.y-cy)*fy+(p.z-cz)*fz AS u, (p.x-cx)*qx+(p.y-cy)*qy+(p.z-cz)*qz AS v,
  (p.x-cx)*ux+(p.y-cy)*uy+(p.z-cz)*uz AS w
  FROM points p JOIN seg s ON p.run = s.run AND floor(-p.y/4) BETWEEN floor(-s.cy/4)-1 AND floor(-s.cy/4)+1
  WHERE p.y <= 0 AND NOT (p.x = 0 AND p.y = 0 AND p.z = 0)),
hits AS (SELECT run, frame, point_idx, min(k) AS k, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z,
  min(sqrt(x*x+y*y+z*z)) AS range_m
  FROM mm WHERE u >= 0 AND u <= len AND abs(v) < 1.05-0.030001 AND w > 0.100001 AND w < 3.0-0.030001
  GROUP BY run, frame, point_idx)"""
