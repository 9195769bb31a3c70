"""Schemas of the datasets, as DDL: stated, never inferred, since absent keys mean something."""

ASR = "segments array<struct<start:double,end:double,words:array<struct<word:string,start:double,end:double>>>>"
TRANSCRIPT = "source string, model string, language string, duration double, words array<struct<start:double,end:double,text:string>>, segments array<struct<start:double,end:double,text:string>>"
WORD = "i bigint, w string, s double, e double, b bigint"
SPEECH_MAP = "source string, fps double, duration double, width int, height int, samplerate int, thresholds struct<in:string,out:string,rescued:boolean>, blocks array<struct<i:int,start:double,end:double,onset:double,text:string,gap_after:double>>"
RANGE = "struct<start_word:bigint,end_word:bigint>"
CANDIDATES = f"clips array<struct<title:string,headline:string,hook_mode:string,hook_quote:string,register:string,why:string,teaser:{RANGE},segments:array<{RANGE}>,scores:map<string,int>,descriptions:map<string,string>>>"
CUTS = "source string, sequence_name string, output string, fps double, source_duration double, width int, height int, samplerate int, clips array<struct<in_frame:bigint,out_frame:bigint,text:string,teaser:boolean>>"
SCENES = "fps double, regions array<struct<seg:int,in_frame:bigint,out_frame:bigint,probe:string>>"
PLAN = "regions array<struct<in_frame:bigint,out_frame:bigint,mode:string,face_x:double,inset:array<double>,content:array<double>,zone:array<double>,rects_from:string>>"
PROBE = "regions array<struct<seg:int,in_frame:bigint,out_frame:bigint,faces:array<struct<box:array<double>,hits:int>>,full_face_x:double,cam:struct<rect:array<double>,conf:double,face:array<double>>,content:struct<rect:array<double>,fill:double,source:string>,motion:array<double>,panel:array<double>,void:boolean,suggest:string,error:string>>"
BOX = "struct<x:double,y:double,w:double,h:double,conf:double>"
DETECTIONS = f"file string, width double, height double, faces array<{BOX}>, humans array<{BOX}>"
PACKAGE = "name string, path string, date string, mode string, clips array<struct<file:string,rank:int,score:int,title:string>>"
CONTAINER = "streams array<struct<codec_type:string,r_frame_rate:string,width:int,height:int,sample_rate:string>>, format struct<duration:string>"
