"""The same derived tables as sub-selects for the checking SQL."""

from .registry import cte

cte("fx_releases", """
SELECT o_orderkey // 15000 AS site, o_orderstatus || (o_orderkey // 15000) AS run_id, o_orderkey AS particle,
  CAST(900 + (o_orderkey*37) % 1800 AS DOUBLE) AS t_release,
  5.0::DOUBLE + CAST(o_custkey % 21 - 10 AS DOUBLE)/10.0::DOUBLE AS rel_u,
  CAST(o_orderkey % 13 - 6 AS DOUBLE)/10.0::DOUBLE AS rel_v,
  CAST(CAST(round(o_totalprice*100) AS BIGINT) % 2001 - 900 AS DOUBLE)/1000.0::DOUBLE AS rel_w
FROM orders""")

cte("fx_touchdowns", """
SELECT o_orderkey // 15000 AS site, o_orderstatus || (o_orderkey // 15000) AS run_id, l_orderkey AS particle,
  CAST(-10*((l_partkey*31 + l_linenumber*17) % 600) + 4*((l_suppkey*13) % 41 - 5) AS DOUBLE) + 768.0::DOUBLE AS td_x,
  CAST(15*((l_suppkey*29 + l_linenumber*7) % 121 - 60) AS DOUBLE) + 768.0::DOUBLE AS td_y,
  l_discount*4.0::DOUBLE AS td_w, l_quantity*18.0::DOUBLE AS td_age
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")

cte("fx_cell_keys", """
SELECT *, o_orderkey // 384 AS n, (o_orderkey // 64) % 6 AS k FROM orders""")
cte("fx_cell_units", """
SELECT 'r' || (n // 16) AS run_id, n % 16 AS step, k, (o_orderkey // 8) % 8 AS j, o_orderkey % 8 AS i,
  greatest(1.2::DOUBLE - CAST(abs(k-1) AS DOUBLE)*0.3::DOUBLE, 0.1::DOUBLE) AS amp,
  CAST((o_orderkey*7919 + o_custkey*31) % 2003 AS DOUBLE)/2003.0::DOUBLE AS a,
  CAST((o_orderkey*104729 + o_custkey*17) % 1999 AS DOUBLE)/1999.0::DOUBLE AS b,
  CAST((o_orderkey*1299709 + o_custkey*13) % 1993 AS DOUBLE)/1993.0::DOUBLE AS d,
  CAST((o_orderkey*15485863 + o_custkey*11) % 1987 AS DOUBLE)/1987.0::DOUBLE AS e,
  CAST((o_orderkey*32452843 + o_custkey*7) % 1979 AS DOUBLE)/1979.0::DOUBLE AS g
FROM fx_cell_keys""")
cte("fx_cells", """
SELECT run_id, step, k, j, i,
  5.0::DOUBLE + k/2.0::DOUBLE + amp*(a-0.5::DOUBLE) AS u, 0.5::DOUBLE + k/10.0::DOUBLE + amp*(b-0.5::DOUBLE) AS v,
  amp*(d-0.5::DOUBLE) AS w, (e*0.5::DOUBLE + 0.05::DOUBLE)*(1.0::DOUBLE - k/8.0::DOUBLE) AS tke,
  300.0::DOUBLE + k/2.0::DOUBLE + (g-0.5::DOUBLE)/5.0::DOUBLE + amp*(d-0.5::DOUBLE)*(0.2::DOUBLE - k/10.0::DOUBLE) AS theta,
  CASE WHEN step = 0 THEN 4.0::DOUBLE + 9.0::DOUBLE*k + k*k/2.0::DOUBLE END AS z_pos
FROM fx_cell_units""")
cte("fx_surface_dumps", """
SELECT run_id, step, j, i, 0.2::DOUBLE + avg(tke)/2.0::DOUBLE AS ustar, 0.01::DOUBLE + avg(tke)/20.0::DOUBLE AS z0m,
  (avg(w)-0.2::DOUBLE)/50.0::DOUBLE AS inv_l,
  CASE WHEN run_id <> 'r1' THEN (avg(theta)-301.0::DOUBLE)/20.0::DOUBLE END AS ht_flux
FROM fx_cells GROUP BY run_id, step, j, i""")

cte("fx_pixel_keys", """
SELECT *, (l_partkey*31 + l_linenumber*17) % 64 AS j, (l_suppkey*29 + l_orderkey*7) % 64 AS i,
  CAST(l_quantity AS BIGINT) AS q FROM lineitem""")
cte("fx_pixel_blocks", """
SELECT *, (j // 8 + (i // 8)*3) % 6 AS blk FROM fx_pixel_keys""")
cte("fx_pixels", """
SELECT l_orderkey // 15000 AS site, j, i,
  CASE WHEN blk = 3 THEN 250.0::DOUBLE + l_tax/11.0::DOUBLE
       ELSE 251.0::DOUBLE + l_extendedprice/4999.0::DOUBLE + j/8.0::DOUBLE END AS elevation,
  [40, 10, 30, 80, 50, 90][1 + CASE WHEN blk = 3 OR q % 3 <> 0 THEN blk ELSE (blk + q) % 6 END] AS lcclass
FROM fx_pixel_blocks""")

cte("fx_hourly", """
SELECT user_id % 3 AS site, event_id AS rec, (epoch_us(ts) - 307584000000000) // 3600000000 AS time_hours,
  value/40.0::DOUBLE - 3.0::DOUBLE AS u10, CAST((event_id*7919) % 2001 - 1000 AS DOUBLE)/200.0::DOUBLE AS v10,
  CAST((event_id*104729) % 1501 - 300 AS DOUBLE) AS acshflsm, CAST((event_id*31) % 2000 AS DOUBLE) AS pblh,
  CAST(280 + event_id % 25 AS DOUBLE) AS tk, CAST(98000 + event_id % 3000 AS DOUBLE) AS psfc
FROM events""")
cte("fx_tower", """
SELECT user_id % 10 AS station, ts, 3.0::DOUBLE + value/100.0::DOUBLE AS u,
  CAST(event_id % 21 - 10 AS DOUBLE)/10.0::DOUBLE AS v, CAST(event_id % 41 - 20 AS DOUBLE)/50.0::DOUBLE AS w
FROM events""")
cte("fx_logs", """
SELECT user_id AS log_id, event_id AS line_no, ts,
  CASE WHEN event_type = 'error' THEN '****CORRUPTED*** --- (#NaN, 0)'
       WHEN event_type = 'purchase' THEN 'simulation is complete'
       ELSE 'step ' || event_id END AS line
FROM events""")
cte("fx_tracks", """
SELECT user_id AS particle, event_id AS seq, epoch_us(ts)/1000000.0::DOUBLE AS t,
  epoch_us(ts) // 86400000000 AS day, CAST(-(event_id % 997) AS DOUBLE) AS x, CAST(event_id % 89 AS DOUBLE) AS y,
  value/10.0::DOUBLE AS z
FROM events""")
