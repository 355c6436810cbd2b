"""Property-market inputs derived from the given tables.

Each input is one SELECT in SQL that Spark and the checking engine both read, so both sides
start from equal rows. Only the dialect marks `@day(x)` (days since 1995-01-01), `@secs(x)`
(epoch seconds) and `{table}` differ. The operators themselves never come from here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from hearthspan.sources.tables import TABLES

_AREA = """
  'N' || CAST(k % 20 + 1 AS STRING) AS outcode,
  'N' || CAST(k % 20 + 1 AS STRING) || ' ' || CAST(CAST(floor(k / 20) AS BIGINT) % 5 AS STRING) AS sector,
  'N' || CAST(k % 20 + 1 AS STRING) || ' ' || CAST(CAST(floor(k / 20) AS BIGINT) % 5 AS STRING)
      || chr(CAST(65 + CAST(floor(k / 100) AS BIGINT) % 4 AS INT)) || 'A' AS postcode
"""

DEFS: dict[str, str] = {}

# Sale ledger: one row per line item, dates stretched fourfold to 1995-2022.
DEFS["sales"] = f"""
SELECT k AS address_key, DATE '1995-01-01' + CAST(4 * d AS INT) AS sale_date,
  CAST(round(300000 + 2 * l_extendedprice + 80 * d) AS BIGINT) AS price, {_AREA},
  CASE p_size % 5 WHEN 0 THEN 'F' WHEN 1 THEN 'T' WHEN 2 THEN 'S' WHEN 3 THEN 'D' ELSE 'O' END AS property_type,
  CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 5 = 0 THEN 'B' ELSE 'A' END AS category,
  CASE WHEN l_returnflag = 'A' THEN 'F' WHEN l_returnflag = 'N' THEN 'L' ELSE NULL END AS tenure,
  CASE WHEN l_linestatus = 'O' THEN 'Y' ELSE 'N' END AS new_build,
  CAST(k % 60 + 1 AS STRING) AS paon,
  CASE WHEN p_size % 5 = 0 THEN 'FLAT ' || CAST(k % 9 + 1 AS STRING) ELSE NULL END AS saon,
  CASE k % 6 WHEN 0 THEN 'ELM ROAD' WHEN 1 THEN 'MILL LANE' WHEN 2 THEN 'HIGH STREET' WHEN 3 THEN 'PARK AVENUE'
       WHEN 4 THEN 'STATION WAY' ELSE 'QUEENS DRIVE' END AS street,
  CAST(400 + (k * 37) % 1400 AS BIGINT) AS floor_area_sqft, CAST(p_size % 5 + 1 AS BIGINT) AS bedrooms,
  l_orderkey AS tie1, CAST(l_linenumber AS BIGINT) AS tie2, l_suppkey AS tie3,
  CAST(year(DATE '1995-01-01' + CAST(4 * d AS INT)) AS INT) AS sale_year
FROM (SELECT l.*, p.p_size, l.l_partkey AS k, @day(l_shipdate) AS d
      FROM {{lineitem}} l JOIN {{part}} p ON l.l_partkey = p.p_partkey) x
"""

# The same ledger by home: an address of the ledger split into homes with few sales each.
DEFS["home_sales"] = """
SELECT address_key * 16 + tie1 % 16 AS address_key, sale_date, price, outcode, sector, postcode, property_type, category, bedrooms, tie1, tie2, tie3 FROM sales
"""

# Listing snapshot: one row per part.
DEFS["listings"] = f"""
SELECT k AS id, {_AREA},
  CASE WHEN k % 7 = 0 THEN replace('N' || CAST(k % 20 + 1 AS STRING) || ' ' || CAST(CAST(floor(k / 20) AS BIGINT) % 5 AS STRING)
      || chr(CAST(65 + CAST(floor(k / 100) AS BIGINT) % 4 AS INT)) || 'a', ' ', '')
    ELSE 'N' || CAST(k % 20 + 1 AS STRING) || ' ' || CAST(CAST(floor(k / 20) AS BIGINT) % 5 AS STRING)
      || chr(CAST(65 + CAST(floor(k / 100) AS BIGINT) % 4 AS INT)) || 'A' END AS raw_postcode,
  CASE WHEN k % 41 = 0 THEN NULL ELSE CAST(round(p_retailprice * 400) + (k * 7919) % 90000 AS BIGINT) END AS asking_price,
  CAST(p_size % 5 + 1 AS BIGINT) AS bedrooms, CAST(p_size % 3 + 1 AS BIGINT) AS bathrooms,
  CAST(CASE WHEN k % 13 = 0 THEN 0 ELSE 400 + (k * 37) % 1400 END AS BIGINT) AS floor_area_sqft,
  CASE k % 11 WHEN 0 THEN 'Flat' WHEN 1 THEN 'Terraced' WHEN 2 THEN 'Semi-Detached' WHEN 3 THEN 'Detached'
    WHEN 4 THEN 'Maisonette' WHEN 5 THEN 'Studio' WHEN 6 THEN 'Bungalow' WHEN 7 THEN 'Penthouse'
    WHEN 8 THEN 'House' WHEN 9 THEN 'Land' ELSE NULL END AS property_type,
  CASE k % 4 WHEN 0 THEN 'Freehold' WHEN 1 THEN 'Leasehold' WHEN 2 THEN 'SHARE OF FREEHOLD' ELSE NULL END AS tenure,
  CASE WHEN k % 5 = 0 THEN DATE '2023-01-01' + CAST(k % 300 AS INT) ELSE NULL END AS delisted_date,
  CASE WHEN k % 11 = 0 THEN k - 1 WHEN k % 2 = 0 THEN NULL ELSE k END AS canonical_id,
  CASE WHEN k % 23 = 0 THEN 1 ELSE 0 END AS shared_ownership,
  CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END AS is_auction,
  CASE WHEN k % 3 = 0 THEN NULL ELSE DATE '2023-06-01' + CAST(k % 500 AS INT) END AS first_visible_date,
  DATE '2023-05-20' + CAST(k % 520 AS INT) AS date_listed,
  CASE WHEN k % 4 = 3 THEN NULL ELSE CAST(300000 + (k * 104729) % 250000 AS BIGINT) END AS prev_sold_price,
  CASE WHEN k % 9 = 8 THEN NULL ELSE DATE '2012-01-01' + CAST((k * 31) % 4300 AS INT) END AS prev_sold_date,
  CASE WHEN k % 6 = 5 THEN 'fuzzy' ELSE 'detail_anchored' END AS match_strategy,
  CASE WHEN k % 10 = 9 THEN NULL ELSE DATE '2024-06-01' END AS flood_checked_at,
  CASE k % 8 WHEN 0 THEN 'FZ3' WHEN 1 THEN 'FZ2' ELSE 'FZ1' END AS flood_zone,
  CASE k % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Rear garden' WHEN 2 THEN '' WHEN 3 THEN NULL
    WHEN 4 THEN 'Roof Terrace' WHEN 5 THEN 'Ask agent' ELSE 'Balcony' END AS garden,
  CASE k % 9 WHEN 0 THEN 'south' WHEN 1 THEN 'south-west' WHEN 2 THEN 'north-east' WHEN 3 THEN 'east'
    WHEN 4 THEN 'west' WHEN 5 THEN 'north-west' ELSE NULL END AS garden_facing,
  CASE k % 6 WHEN 0 THEN 'Garage' WHEN 1 THEN 'No parking' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'Off street' ELSE NULL END AS parking,
  CASE k % 10 WHEN 0 THEN '["Open-plan kitchen", "Lift access", "Off street parking"]'
    WHEN 1 THEN '["Private Balcony", "No parking", "Fireplace"]' WHEN 2 THEN '["Terraced house", "Driveway"]'
    WHEN 3 THEN '["Roof terrace", "Elevator"]' WHEN 4 THEN '["Conservatory", "Garage", "No allocated parking"]'
    WHEN 5 THEN '["Open plan living room. Modern kitchen"]' WHEN 6 THEN '["Carport", "Period fireplace"]'
    WHEN 7 THEN NULL WHEN 8 THEN '["Openplan lounge and kitchen diner"]' ELSE '["Chain free"]' END AS key_features,
  CASE k % 12 WHEN 0 THEN 'A bright home with an open plan reception room and kitchen, and a private balcony.'
    WHEN 1 THEN 'This is a <b>first floor flat</b> with no lift and a shared hall.'
    WHEN 2 THEN 'Scope to create an open plan kitchen at the rear, subject to consent.'
    WHEN 3 THEN 'Set on the third floor with a lift. There is no balcony.'
    WHEN 4 THEN 'A family house converted into flats next door, ideal for growing families.'
    WHEN 5 THEN 'Two bedroom apartment in a purpose built block, without a balcony.'
    WHEN 6 THEN NULL WHEN 7 THEN 'Open plan living area with a large garden and a separate kitchen.'
    WHEN 8 THEN 'Ground floor maisonette with its own entrance.'
    WHEN 9 THEN 'House with the potential to extend into the loft.'
    WHEN 10 THEN 'The balcony faces the river and the lift is new.' ELSE 'Freehold house in a quiet street.' END AS description,
  CASE WHEN k % 3 = 1 THEN NULL ELSE CAST((k * 17) % 160 AS BIGINT) END AS lease_years,
  CASE k % 5 WHEN 0 THEN 0.0 WHEN 1 THEN NULL ELSE CAST(600 + (k * 13) % 4000 AS DOUBLE) END AS service_charge,
  CASE k % 4 WHEN 0 THEN NULL ELSE CAST((k * 11) % 600 AS DOUBLE) END AS ground_rent,
  CASE WHEN k % 12 = 5 THEN NULL ELSE CAST(20 + (k * 7) % 80 AS BIGINT) END AS epc_efficiency,
  CASE k % 10 WHEN 8 THEN 'Deleted' WHEN 9 THEN NULL ELSE chr(CAST(65 + k % 10 AS INT)) END AS council_tax_band,
  CASE k % 5 WHEN 0 THEN '[]' WHEN 1 THEN NULL WHEN 2 THEN '["short_lease"]' WHEN 3 THEN '["cladding", "auction"]' ELSE '[]' END AS mortgage_flags,
  CASE k % 6 WHEN 0 THEN 'likely' WHEN 1 THEN 'unlikely' ELSE NULL END AS ex_council,
  CASE k % 8 WHEN 0 THEN 'Reduced on ' || CASE WHEN k % 28 < 9 THEN '0' ELSE '' END || CAST(k % 28 + 1 AS STRING) || '/0'
      || CAST(k % 9 + 1 AS STRING) || '/2024' WHEN 1 THEN 'Reduced today' WHEN 2 THEN 'Added on 01/02/2024' ELSE NULL END AS update_reason,
  CAST(floor(k / 3) AS BIGINT) AS delivery_point, CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS reads_as_flat,
  CASE WHEN k % 5 = 4 THEN NULL ELSE CAST((k * 53) % 1000 AS DOUBLE) / 10 END AS decor_score
FROM (SELECT p.*, p_partkey AS k FROM {{part}} p) x
"""

# Facts read from listing text, one row per listing that was read.
DEFS["text_facts"] = """
SELECT p_partkey AS id, CASE WHEN p_partkey % 19 = 0 THEN 0 ELSE 1 END AS ok,
  CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END AS chain_free, CASE WHEN p_partkey % 31 = 0 THEN 1 ELSE 0 END AS cladding_issue,
  '{{"lift": {{"value": ' || CASE p_partkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE 'null' END
    || '}}, "share_of_freehold": {{"value": ' || CASE WHEN p_partkey % 8 = 0 THEN '1' ELSE '0' END
    || '}}, "service_charge_pa": {{"value": ' || CAST(p_partkey % 3000 AS STRING)
    || '}}, "ground_rent_pa": {{"value": ' || CAST(p_partkey % 450 AS STRING)
    || '}}, "ews1_status": {{"value": "' || CASE WHEN p_partkey % 37 = 0 THEN 'issue_mentioned' ELSE 'none' END || '"}}}}' AS facts_json,
  CASE WHEN p_partkey % 9 = 0 THEN '["open_plan_kitchen", "bright"]' ELSE '["bright"]' END AS open_tags
FROM {part} WHERE p_partkey % 4 <> 3
"""

# Floor-plan reading, one row per listing with a plan.
DEFS["plans"] = """
SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE 1 END AS ok,
  CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS has_garden, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS has_garage,
  CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END AS has_balcony, CASE WHEN p_partkey % 14 = 0 THEN 1 ELSE 0 END AS has_terrace,
  CASE WHEN p_partkey % 16 = 0 THEN 1 ELSE 0 END AS has_conservatory, CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS has_fireplace
FROM {part} WHERE p_partkey % 3 <> 2
"""

# Room areas read from plans: one row per line item of the listing.
DEFS["rooms"] = """
SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS room_no,
  CASE l_linenumber WHEN 1 THEN 'bedroom' WHEN 2 THEN 'reception' WHEN 3 THEN 'kitchen' WHEN 4 THEN 'balcony'
    WHEN 5 THEN 'garden' WHEN 6 THEN 'terrace' ELSE 'living' END AS room_type,
  CASE CAST(l_linenumber AS BIGINT) * 3 + l_suppkey % 3
    WHEN 3 THEN 'Bedroom 1' WHEN 4 THEN 'Master Bedroom' WHEN 5 THEN 'Bed 2' WHEN 6 THEN 'Reception Room' WHEN 7 THEN 'Lounge'
    WHEN 8 THEN 'Reception' WHEN 9 THEN 'Kitchen' WHEN 10 THEN 'Kitchen/Diner' WHEN 11 THEN 'Kitchen' WHEN 12 THEN 'Balcony'
    WHEN 13 THEN 'Front Balcony' WHEN 14 THEN 'Ground Floor Balcony' WHEN 15 THEN 'Rear Garden' WHEN 16 THEN 'Garden Room'
    WHEN 17 THEN 'Communal Garden' WHEN 18 THEN 'Roof Terrace' WHEN 19 THEN 'Terrace' WHEN 20 THEN 'Garden Terrace'
    ELSE 'Living Room' END AS label,
  l_quantity * 6 AS area_sqft, CAST(1 + l_suppkey % 9 AS DOUBLE) AS long_edge_m
FROM {lineitem}
"""

# The rooms of a plan under all its types: outdoor rooms stand for wet rooms and the rarer ones.
DEFS["plan_rooms"] = """
SELECT id, room_no, label, CASE WHEN room_type = 'balcony' THEN CASE room_no % 3 WHEN 0 THEN 'bathroom' WHEN 1 THEN 'shower_room' ELSE 'wc' END
  WHEN room_type = 'garden' THEN CASE room_no % 3 WHEN 0 THEN 'dining' WHEN 1 THEN 'study' ELSE 'utility' END
  WHEN room_type = 'terrace' THEN CASE room_no % 2 WHEN 0 THEN 'storage' ELSE 'cloakroom' END ELSE room_type END AS room_type FROM rooms
"""

DEFS["price_history"] = """
SELECT o_custkey AS property_id, CAST(o_orderdate AS DATE) AS price_date, CAST(round(o_totalprice) AS BIGINT) AS asking_price, o_orderkey AS tie1
FROM {orders}
"""

DEFS["nearest_stations"] = """
SELECT l_partkey AS property_id, 'Station ' || CAST(l_suppkey % 40 AS STRING) AS station_name, l_quantity / 20 AS distance_miles
FROM {lineitem} WHERE l_linenumber = 1
"""

# Hub names and weights are fixed values.
DEFS["commute"] = """
SELECT sector, hub, CAST(min(minutes) AS DOUBLE) AS minutes FROM (
  SELECT 'N' || CAST(c_custkey % 20 + 1 AS STRING) || ' ' || CAST(CAST(floor(c_custkey / 20) AS BIGINT) % 5 AS STRING) AS sector,
    CASE c_nationkey WHEN 0 THEN 'Bank' WHEN 1 THEN 'Liverpool Street' WHEN 2 THEN 'Oxford Circus' WHEN 3 THEN 'Canary Wharf'
      WHEN 4 THEN 'London Bridge' WHEN 5 THEN 'Waterloo' WHEN 6 THEN 'Victoria' WHEN 7 THEN 'King''s Cross' WHEN 8 THEN 'Farringdon'
      WHEN 9 THEN 'Paddington' WHEN 10 THEN 'Old Street' WHEN 11 THEN 'Stratford' WHEN 12 THEN 'Hammersmith'
      WHEN 13 THEN 'Clapham Junction' WHEN 14 THEN 'East Croydon' WHEN 15 THEN 'Wimbledon' WHEN 16 THEN 'Lewisham'
      WHEN 17 THEN 'Ealing Broadway' WHEN 18 THEN 'Highbury & Islington' WHEN 19 THEN 'Heathrow'
      ELSE 'Minor ' || CAST(c_nationkey AS STRING) END AS hub,
    CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 8 + (c_custkey * 7 + c_nationkey * 3) % 80 END AS minutes
  FROM {customer}) c GROUP BY sector, hub
"""

DEFS["coords"] = """
SELECT DISTINCT CASE WHEN k % 7 = 0 THEN replace(pc, ' ', '') ELSE pc END AS postcode, pc AS spaced,
  51.5 + CAST(oc AS DOUBLE) * 0.004 + CAST(sec AS DOUBLE) * 0.0011 + CAST(u AS DOUBLE) * 0.0003 AS latitude,
  -0.2 + CAST(oc % 5 AS DOUBLE) * 0.006 + CAST(sec AS DOUBLE) * 0.0017 + CAST(u AS DOUBLE) * 0.0004 AS longitude
FROM (SELECT oc, sec, u, oc * 20 + sec * 4 + u AS k,
        'N' || CAST(oc + 1 AS STRING) || ' ' || CAST(sec AS STRING) || chr(CAST(65 + u AS INT)) || 'A' AS pc
      FROM (SELECT p_partkey % 20 AS oc, CAST(floor(p_partkey / 20) AS BIGINT) % 5 AS sec, CAST(floor(p_partkey / 100) AS BIGINT) % 4 AS u FROM {part}) a) b
"""

# Schools, stations, parks and venues.
DEFS["places"] = """
SELECT s_suppkey AS place_id, 'Place ' || CAST(s_suppkey % 60 AS STRING) AS name,
  51.5 + CAST((s_suppkey * 37) % 100 AS DOUBLE) * 0.0009 AS latitude, -0.2 + CAST((s_suppkey * 53) % 100 AS DOUBLE) * 0.0005 AS longitude,
  CASE s_suppkey % 4 WHEN 0 THEN 'restaurant' WHEN 1 THEN 'cafe' WHEN 2 THEN 'gym' ELSE 'supermarket' END AS kind,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 3.0 + CAST((s_suppkey * 7) % 20 AS DOUBLE) / 10 END AS rating,
  (s_suppkey * 13) % 400 AS reviews,
  CASE s_suppkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE NULL END AS ofsted,
  CASE WHEN s_suppkey % 7 = 3 THEN 'all-through' ELSE CASE s_suppkey % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'nursery' ELSE 'sixth form' END END AS phase,
  s_acctbal AS weight
FROM {supplier}
"""

# Wide score table: one row per unit postcode.
DEFS["scores"] = """
SELECT postcode, outcode, sector,
  CASE WHEN k % 9 = 0 THEN NULL ELSE CAST((k * 37) % 900 AS DOUBLE) / 10 + 5 END AS transport,
  CASE WHEN k % 10 = 1 THEN NULL ELSE CAST((k * 53) % 950 AS DOUBLE) / 10 + 3 END AS community,
  CASE WHEN k % 8 = 2 THEN NULL ELSE CAST((k * 71) % 600 AS DOUBLE) / 10 + 35 END AS environment,
  CASE WHEN k % 7 = 3 THEN NULL ELSE CAST((k * 29) % 700 AS DOUBLE) / 10 + 25 END AS price,
  CASE WHEN k % 6 = 4 THEN NULL ELSE CAST((k * 43) % 500 AS DOUBLE) / 10 + 48 END AS schools,
  CASE WHEN k % 11 = 5 THEN NULL ELSE CAST((k * 61) % 800 AS DOUBLE) / 10 + 15 END AS total_score,
  CASE WHEN k % 12 = 6 THEN NULL ELSE median_price END AS median_price
FROM (SELECT postcode, outcode, sector, min(address_key) AS k, min(price) AS median_price FROM sales GROUP BY postcode, outcode, sector) s
"""

# Versioned score documents, one row per (postcode, version); payload is JSON text.
DEFS["score_docs"] = """
SELECT postcode, 'v' || CAST(tie2 % 3 + 1 AS STRING) AS data_version, sale_date AS created_on, tie1 AS doc_no,
  CASE WHEN tie1 % 29 = 0 THEN '{{broken' WHEN tie1 % 23 = 0 THEN '{{"_no_data": true}}'
    ELSE '{{"score": ' || CAST(tie1 % 100 AS STRING) || ', "count": ' || CAST(tie3 AS STRING) || '}}' END AS data_json,
  CASE WHEN tie1 % 23 = 0 THEN NULL ELSE CAST(tie1 % 100 AS DOUBLE) END AS score,
  sale_date + CAST(30 + tie3 AS INT) AS expires_on, tie2, tie3, price
FROM sales
"""

# Monitoring rows from the event stream.
DEFS["runs"] = """
SELECT event_id AS run_id, CAST(ts AS TIMESTAMP) AS started_at, @secs(ts) AS at_s, user_id, event_type AS job,
  CASE WHEN event_type = 'error' OR event_id % 11 = 0 THEN 'failed' WHEN event_id % 13 = 0 THEN 'dispatched' ELSE 'completed' END AS status,
  value AS latency, CAST(user_id % 8 AS BIGINT) AS queue_no,
  CASE WHEN event_id % 11 = 0 THEN 'daily_limit_reached for today' WHEN event_id % 17 = 0 THEN 'database is locked'
       WHEN event_type = 'error' THEN 'timeout' ELSE NULL END AS error_message,
  CASE WHEN user_id % 10 = 0 THEN 'test-' || CAST(user_id AS STRING) WHEN event_id % 41 = 0 THEN NULL ELSE 's' || CAST(user_id * 100 + event_id % 7 AS STRING) END AS session_id,
  CASE WHEN event_id % 26 = 0 THEN '{{"mode": "catchup"}}' WHEN event_id % 13 = 0 THEN '{{"mode": "daily"}}' WHEN event_id % 5 = 0 THEN 'not json' END AS summary
FROM {events}
"""

# Chat turns: a user turn with the next assistant turn.
DEFS["chats"] = """
SELECT u.conv_id, u.turn,
  CASE WHEN (u.conv_id + u.turn) % 5 = 0 THEN 'Find me a 2 bed flat in N1, budget 500k' WHEN (u.conv_id + u.turn) % 5 = 1 THEN 'Show me homes like this in SE1' ELSE u.text END AS user_text,
  CASE (u.conv_id * 7 + u.turn) % 9 WHEN 0 THEN 'Thanks, I do not have a tool for that, sorry.' WHEN 1 THEN '这并不是, 我没有这些数据。' WHEN 2 THEN '好的，我没有这个小区的数据。'
    WHEN 3 THEN 'Our data only covers for-sale listings.' ELSE a.text END AS assistant_text, 's' || CAST(u.conv_id AS STRING) AS session_id,
  CASE WHEN (u.conv_id + u.turn) % 4 = 0 THEN '[{{"tool": "search", "args": {{"n": 3}}}}, {{"tool": "score"}}]' WHEN (u.conv_id + u.turn) % 4 = 1 THEN '[]'
       WHEN (u.conv_id + u.turn) % 4 = 2 THEN 'not json' ELSE '[{{"tool": "score"}}, {{"tool": "comps"}}, {{"tool": "score"}}]' END AS tool_calls,
  u.conv_id * 1000 + u.turn AS msg_id
FROM {conversations} u JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'
"""

# Image scores, one row per line item of a property.
DEFS["images"] = """
SELECT l_partkey AS property_id, l_orderkey * 10 + l_linenumber AS image_no, l_extendedprice / 1050 AS score,
  CASE WHEN l_linenumber <= 4 THEN 1 ELSE 0 END AS is_interior, 'm' || CAST(l_suppkey % 3 AS STRING) AS model_tag, l_suppkey AS tie3
FROM {lineitem}
"""

# Postcodes of many shapes: spaced, tight and lower case, units, sectors and outcodes.
DEFS["mixed_postcodes"] = """
SELECT k, oc, CASE k % 6 WHEN 0 THEN oc || ' ' || CAST(k % 10 AS STRING) || 'AB' WHEN 1 THEN lower(oc) || CAST(k % 10 AS STRING) || 'xy'
    WHEN 2 THEN oc WHEN 3 THEN oc || ' ' || CAST(k % 10 AS STRING) WHEN 4 THEN '  ' || oc || '   ' || CAST(k % 10 AS STRING) || 'QT ' ELSE oc || CAST(k % 10 AS STRING) || 'LM' END AS raw
FROM (SELECT c_custkey AS k, CASE c_nationkey WHEN 0 THEN 'EC1A' WHEN 1 THEN 'W2' WHEN 2 THEN 'SW1A' WHEN 3 THEN 'E15' WHEN 4 THEN 'RM10'
    WHEN 5 THEN 'SE1' WHEN 6 THEN 'NW1' WHEN 7 THEN 'BR3' WHEN 8 THEN 'N1C' WHEN 9 THEN 'E1' WHEN 10 THEN 'N19' WHEN 11 THEN 'N1' WHEN 12 THEN 'SW11'
    WHEN 13 THEN 'KT2' WHEN 14 THEN 'M1' WHEN 15 THEN 'B33' WHEN 16 THEN 'WD17' WHEN 17 THEN 'E1W' WHEN 18 THEN 'NW10' WHEN 19 THEN 'SE18'
    WHEN 20 THEN 'GU1' WHEN 21 THEN 'HA1' WHEN 22 THEN 'TW9' WHEN 23 THEN 'L1' ELSE 'W1K' END AS oc FROM {customer}) c
"""

# Addresses of sales as free text and of certificates in another wording.
DEFS["certificates"] = """
SELECT DISTINCT address_key AS cert_no, postcode, floor_area_sqft,
  CASE WHEN saon IS NOT NULL THEN replace(saon, 'FLAT', 'Apartment') || ', ' ELSE '' END || paon || CASE WHEN address_key % 3 = 0 THEN ', ' ELSE ' ' END || street || ', London' AS cert_address
FROM sales WHERE address_key % 10 <> 9
"""

# Main borough of an outcode and the share it covers; yearly council tax by band.
DEFS["boroughs"] = """
SELECT 'N' || CAST(n_nationkey + 1 AS STRING) AS outcode, 'Borough ' || CAST(n_regionkey AS STRING) AS borough,
  CASE WHEN n_nationkey % 7 = 0 THEN NULL WHEN n_nationkey % 4 = 1 THEN 0.62 ELSE CAST(86 + n_nationkey % 14 AS DOUBLE) / 100 END AS share
FROM {nation} WHERE n_nationkey < 20
"""
DEFS["tax_rates"] = """
SELECT 2019 + CAST(floor(n_nationkey / 5) AS BIGINT) AS tax_year, 'Borough ' || CAST(n_regionkey AS STRING) AS borough,
  CAST(900 + n_nationkey * 17 AS DOUBLE) AS band_a, CAST(1300 + n_nationkey * 31 AS DOUBLE) AS band_d, CAST(2700 + n_nationkey * 53 AS DOUBLE) AS band_h
FROM {nation}
"""

DEFS["dp_quality"] = """
SELECT DISTINCT CAST(floor(p_partkey / 3) AS BIGINT) AS delivery_point, CASE WHEN CAST(floor(p_partkey / 3) AS BIGINT) % 4 = 3 THEN 0 ELSE 1 END AS is_unit_level FROM {part}
"""

# Garden direction read from plans, several readings per property.
DEFS["facings"] = """
SELECT l_partkey AS property_id, CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 END AS emitted,
  CASE WHEN l_partkey % 5 = 0 AND l_linenumber > 3 THEN '|west|' WHEN l_partkey % 4 = 0 THEN '|south|south-west|' WHEN l_partkey % 4 = 1 THEN '|north-east|'
    WHEN l_partkey % 4 = 2 THEN '|east|' ELSE NULL END AS facing_set,
  CASE WHEN l_partkey % 6 = 1 THEN 'balcony' ELSE 'garden' END AS outdoor_type
FROM {lineitem}
"""

# Judged cases and answers.
DEFS["critic"] = """
SELECT d.doc_id AS case_id, d.source AS source_file, CASE WHEN quality = 1 THEN 'pass' WHEN d.doc_id % 3 = 0 THEN 'major' ELSE 'minor' END AS verdict,
  CASE d.doc_id % 5 WHEN 0 THEN '[]' WHEN 1 THEN '[{{"severity": "high", "category": "tool_hallucination", "detail": "made up"}}, {{"severity": "low", "category": "format", "detail": "long"}}]'
    WHEN 2 THEN '[{{"severity": "low", "category": "format", "detail": "critic output was unparseable: x"}}]' WHEN 3 THEN '[{{"severity": "medium", "category": "incomplete", "detail": "short"}}]'
    ELSE '[{{"severity": "high", "category": "missing_hedge", "detail": "sure"}}]' END AS issues,
  CASE WHEN d.doc_id % 17 = 0 THEN 'critic call failed: timeout' ELSE NULL END AS error
FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id
"""
DEFS["answers"] = """
SELECT doc_id AS case_id, source AS model, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS thinking, CASE WHEN doc_id % 13 = 0 THEN '  ' ELSE text END AS response,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(n_chars % 900 AS DOUBLE) / 10 END AS wall_s, CAST(n_chars % 4 AS BIGINT) AS tool_calls, CASE WHEN doc_id % 19 = 0 THEN 'boom' ELSE NULL END AS error, lang AS grp
FROM {documents}
"""

# Orientation readings: error against the truth, spread, and four frames' sides.
DEFS["readings"] = """
SELECT l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS reading_id, l_partkey AS property_id, CAST((l_orderkey * 7 + l_partkey) % 360 AS DOUBLE) AS truth,
  CAST((l_orderkey * 7 + l_partkey + (l_suppkey * 13) % 29) % 360 AS DOUBLE) AS pred, l_quantity AS spread, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 0 ELSE 1 END AS present,
  l_discount * 10 AS presence_prob, l_orderkey % 4 AS f1, CASE WHEN l_suppkey % 3 = 0 THEN l_orderkey % 4 ELSE l_partkey % 4 END AS f2, CASE WHEN l_suppkey % 5 = 0 THEN l_partkey % 4 ELSE l_orderkey % 4 END AS f3,
  CASE WHEN l_suppkey % 7 = 0 THEN -1 ELSE l_orderkey % 4 END AS f4, CASE WHEN l_suppkey % 11 < 8 THEN l_orderkey % 4 ELSE (l_orderkey + 1) % 4 END AS side
FROM {lineitem}
"""

_DEPS = {"plan_rooms": ("rooms",), "home_sales": ("sales",), "certificates": ("sales",), "scores": ("sales",), "score_docs": ("sales",)}


def _closure(names) -> list[str]:
    out: list[str] = []
    for name in names:
        for need in (*_closure(_DEPS.get(name, ())), name):
            if need not in out:
                out.append(need)
    return out


def _spark_text(name: str, root: str, given: dict[str, DataFrame]) -> str:
    """Braces doubled where inputs are given: spark.sql fills in what stands between single ones, but only then."""
    text = DEFS[name].format(**{t: f"@given({t})" if t in given else f"parquet.`{root}/{t}.parquet`" for t in TABLES})
    if given:
        text = re.sub(r"@given\((\w+)\)", r"{\1}", text.replace("{", "{{").replace("}", "}}"))
    text = re.sub(r"@day\((\w+)\)", r"datediff(CAST(\1 AS DATE), DATE '1995-01-01')", text)
    return re.sub(r"@secs\((\w+)\)", r"unix_seconds(CAST(\1 AS TIMESTAMP))", text)


def _duck_text(name: str) -> str:
    text = DEFS[name].format(**{t: t for t in TABLES})
    text = re.sub(r"@day\((\w+)\)", r"date_diff('day', DATE '1995-01-01', CAST(\1 AS DATE))", text)
    return re.sub(r"@secs\((\w+)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", text)


def build(spark: SparkSession, root: str, name: str, held: dict[str, DataFrame] | None = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """One derived input as a lazy DataFrame; `held` has inputs that are there already, `tables` given tables to read in place of the files."""
    if name not in DEFS:
        raise AttributeError(name)
    *needs, last = _closure([name])
    given = {n: held[n] for n in needs if n in (held or {})} | (tables or {})
    head = ", ".join(f"{n} AS (SELECT * FROM {{{n}}})" if n in given else f"{n} AS ({_spark_text(n, root, given)})" for n in needs)
    return spark.sql((f"WITH {head} " if head else "") + _spark_text(last, root, given), **given)


def needs(name: str) -> tuple[str, ...]:
    """The other inputs that an input is made from."""
    return tuple(_closure([name])[:-1]) if name in DEFS else ()


def with_clause(names, body: str) -> str:
    """The checking query with the inputs it reads in front."""
    parts = [f"{n} AS ({_duck_text(n)})" for n in _closure(names)]
    body = body.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body
