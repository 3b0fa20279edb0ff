"""Declared schemas of stored and exchanged data."""

from __future__ import annotations

EVENT = "struct<label:string,type:string,actor_id:string,successful:boolean,ts:double>"
BOUT = f"id string, athlete_a_id string, athlete_b_id string, winner_id string, win_type string, submission string, event string, stage string, year int, status string, created_at timestamp, sequence array<{EVENT}>, timeline array<{EVENT}>"
MATCHES = "match_id string, year string, winner_name string, loser_name string, win_type string, stage string, submission string, weight_class string, sex string"
TECHNIQUES = "Name string, Position string, Origin string, Type string"
BUNDLE = "schemaVersion int, sessions array<struct<id:string,createdAt:string,duration:double,rounds:array<struct<outcome:string,entries:array<struct<label:string,type:string,actor:string,successful:boolean,assoc:string>>>>>>"
GRAPH = "nodes array<struct<id:string,label:string,type:string,computedElo:double>>, edges array<struct<source:string,target:string,count:bigint,elo:double>>"
ANNOTATIONS = "images array<struct<id:bigint,file_name:string>>, annotations array<struct<image_id:bigint,athlete_idx:int,position:string,role:string,keypoints:array<array<double>>>>"
RULESETS = "rulesets array<struct<id:string,family:string,edition:string,uniform:string,profiles:map<string,struct<windows:array<struct<start_s:double,end_s:double,positive:boolean,negative:boolean>>>>>>"
TAXONOMY = "version int, nodes array<struct<id:string,name:string,kind:string,parents:array<string>,aliases:array<string>>>"
MANIFEST = "divisions array<struct<id:string,name:string,athletes:array<struct<name:string,sources:array<struct<module:string,ruleset_id:string,uniform:string>>>>>>"
