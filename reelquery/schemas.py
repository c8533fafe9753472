"""Schemas of the files that are read and written."""

from __future__ import annotations

SCORES = "frame string, video string, idx int, n_det int, max_conf double"
MANIFEST = "sheet string, tile int, frame string"
SAVED = "file string, video string, frame int, seconds double, n_det int, max_conf double"
SEARCH_RECORD = "id string, name string, split string, annotations struct<count:int,classes:map<string,int>>"
ANNOTATION = "id string, boxes array<struct<type:string,points:array<array<double>>>>"
