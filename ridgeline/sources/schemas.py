"""Declared schemas: optional fields must not vanish because a file lacks them."""

from __future__ import annotations

NODES = "id STRING, name STRING, type STRING, lat DOUBLE, lng DOUBLE, elevation DOUBLE"
EDGES = (
    "`from` STRING, `to` STRING, distance_km STRING, time_min STRING, elevation_gain_m STRING, difficulty STRING, "
    "osm_way_id STRING, trail_name STRING, geometry ARRAY<ARRAY<DOUBLE>>"
)
POIS = NODES + ", nearest_routing_node_id STRING, distance_to_trail_m BIGINT"
OSM = "type STRING, id BIGINT, lat DOUBLE, lon DOUBLE, nodes ARRAY<BIGINT>, tags MAP<STRING,STRING>"
EXTRACT = OSM + ", members ARRAY<STRUCT<type: STRING, ref: BIGINT, role: STRING>>"
#: The place of an element of an extract: file by name, block of the file, place in the block.
ORD = "STRUCT<file: STRING, block: BIGINT, place: BIGINT>"
BUILT_EDGES = (
    "src STRING, dst STRING, distance_km DOUBLE, time_min DOUBLE, elevation_gain_m INT, difficulty INT, "
    "osm_way_id STRING, trail_name STRING, geometry ARRAY<ARRAY<DOUBLE>>"
)
USERS = "id BIGINT, name STRING, email STRING, password_hash STRING, experience_level STRING, created_at TIMESTAMP_NTZ"
PROFILES = "user_id BIGINT, height_cm INT, experience_level STRING, route_preference STRING, updated_at TIMESTAMP_NTZ"
FAVOURITES = (
    "id BIGINT, user_id BIGINT, route_name STRING, start_point_name STRING, end_point_name STRING, distance_km DOUBLE, "
    "time_min INT, elevation_gain_m INT, criterion STRING, path STRING, created_at TIMESTAMP_NTZ"
)
