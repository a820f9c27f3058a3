"""Explicit schemas of the library's tables."""

from __future__ import annotations

PHONES = "array<struct<phone:string,start_ms:bigint,end_ms:bigint>>"
CHARS = "array<struct<ch:string,start_ms:bigint,end_ms:bigint>>"

TABLES: dict[str, str] = {
    "sources": "corpus string, source_id bigint, video_id string, source_file string, title string, url string, ingested_at timestamp",
    "clips": f"corpus string, source_id bigint, clip_id bigint, word string, start_ms bigint, end_ms bigint, source_file string, edited int, phones {PHONES}",
    "noises": "corpus string, source_id bigint, clip_id bigint, word string, start_ms bigint, end_ms bigint, source_file string",
    "reports": "clip_id bigint, kind string, count bigint",
    "ratings": "word string, clip_id bigint, score bigint",
    "recipes": "word string, recipe string",
    "settings": "corpus string, key string, value string",
    "alignments": f"clip_id bigint, alignment {CHARS}, aligned_at timestamp",
    "clip_cache": "clip_id bigint, pad_end double, cache_file string, created_at timestamp",
    "clip_tone": "clip_id bigint, pitch double, pitch_start double, pitch_end double, movement double, loudness double, pace double, brightness double, category int",
    "tone_categories": "id int, name string, centroid array<double>, size bigint",
}

TRANSCRIPT = "source_id bigint, segments array<struct<words:array<struct<word:string,start:double,end:double>>>>"
CAPTIONS = "source_id bigint, events array<struct<tStartMs:double,segs:array<struct<utf8:string,tOffsetMs:double>>>>"
MIDI_EVENTS = "song_id bigint, track bigint, channel bigint, tick bigint, seq bigint, type string, note bigint, velocity bigint, program bigint, tempo bigint"
PRONUNCIATIONS = "word string, value string"
RECIPE = "array<struct<phones:array<string>,from:array<string>,clip_id:bigint,start:double,end:double>>"
