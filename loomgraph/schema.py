"""Schemas of the graph model; the types of nodes and edges are whatever the caller's tables hold."""

from __future__ import annotations

#: Renamed edge types (fixed values).
EDGE_RENAMES = {"Authored": "Author Of", "Funded By": "Funded"}
NODES = "nodeID string, displayName string, nodeType string"
EDGES = "`from` string, `to` string, edgeType string, fromNodeType string, toNodeType string"
PAPER = "struct<origin:string,origin_id:string,doi:string,title:string,abstract:string,_id:string>"
SCIENTIST = "struct<origin_id:string,name:string,institutions:array<struct<name:string,address:string>>>"
VENUE = "struct<name:string,source_type:string>"
TOPIC = "struct<name:string,tag_type:string>"
