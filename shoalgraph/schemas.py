"""Explicit schemas; nothing is inferred from files."""

OCCURRENCES = "species_label string, lng double, lat double, year int, province string, city string, district string, address string, count int, data_source string"
TRIPLES = ["Entity1", "Relationship", "Entity2", "Property", "species_source"]
GEOJSON = "type string, features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
EDGES = "region string, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double"
