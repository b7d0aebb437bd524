"""Schemas of the entities of a recording session."""

from __future__ import annotations

AUDIO_ASSET = "path string, relative_path string, duration_seconds double, signature array<float>"
VIDEO_ASSET = "path string, relative_path string, duration_seconds double, scratch_audio_present boolean, signature array<float>, descriptor array<float>"
PAIR = "lane int, video string, audio string, pair_score double, waveform_score double, duration_score double, duration_delta_seconds double, estimated_offset_seconds double"
ASSIGNMENT = "lane int, video string, audio string, pair_score double, assigned boolean"
BUCKET = "source string, media_type string, bucket string, reason string, confidence double"
EVIDENCE = "take_id string, grp string, media_type string, source string, ts double"
ISSUE = "code string, severity string, subject string, message string"
PROBE = "format struct<filename:string,duration:string>, streams array<struct<index:int,codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,pix_fmt:string,bits_per_sample:string,bits_per_raw_sample:string,sample_rate:string,channels:int,channel_layout:string,duration_ts:long,time_base:string,color_space:string,color_transfer:string,color_primaries:string>>"
VIDEO_CLIP = "take_id string, file string, label string, duration_seconds double, width int, height int, frame_rate double, nominal_frame_rate double, variable_frame_rate boolean, bit_depth int, scratch_audio_present boolean, color_space string, color_transfer string, color_primaries string"
AUDIO_CLIP = "take_id string, file string, duration_seconds double, sample_rate int, channels int, codec_name string, bits_per_sample int, sample_count long, is_pcm boolean"
TAKE = "take_id string, session string, source_dir string, master_audio string, edit_audio string, camera_files array<struct<file:string,label:string>>"
