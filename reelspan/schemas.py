"""Explicit schemas of every stored table; files are never schema-inferred."""

from __future__ import annotations

WORD = "struct<word:string,start:double,end:double,probability:double,speaker:string>"
SEGMENT = f"struct<id:int,start:double,end:double,text:string,speaker:string,words:array<{WORD}>>"
TRANSCRIPT = (
    "project_id string, language string, duration double, engine string, speaker_model_version string, "
    f"speaker_backend string, speaker_coverage double, segments array<{SEGMENT}>, text string"
)
PROBE_STREAM = (
    "struct<codec_type:string,codec_name:string,duration:string,width:int,height:int,avg_frame_rate:string,"
    "r_frame_rate:string,nb_frames:string,disposition:struct<attached_pic:int>>"
)
PROBE = f"path string, streams array<{PROBE_STREAM}>, format struct<duration:string>"
SUGGESTION = "struct<start:double,end:double,summary:string,moment_type:string,hook_text:string,reason:string>"

TABLES = {
    "projects": "id string, name string, author_handle string, source_path string, output_dir string, "
                "created_at timestamp, status string",
    "source_videos": "id string, project_id string, path string, uploaded_at timestamp, seq long, duration double, "
                     "width int, height int, fps double, video_codec string, audio_codec string, metadata_json string",
    "transcripts": "id string, project_id string, language string, duration double, transcript_json_path string, "
                   "srt_path string, created_at timestamp",
    "moments": "id string, project_id string, start double, end double, duration double, text string, summary string, "
               "moment_type string, hook_text string, payoff_text string, semantic_interest_score double, "
               "hook_score double, clarity_score double, emotion_score double, novelty_score double, "
               "standalone_score double, retention_score double, speech_density_score double, "
               "audio_energy_score double, visual_energy_score double, speaker_count int, speaker_switches int, "
               "dialogue_score double, base_score double, personal_score double, final_score double, reason string, "
               "problems array<string>, suggested_title string, suggested_caption string",
    "clips": "id string, project_id string, moment_id string, start double, end double, duration double, "
             "selected boolean, rendered boolean, edit_profile string, created_at timestamp",
    "edit_plans": "id string, project_id string, clip_id string, profile string, operations_json string, "
                  "created_at timestamp",
    "feedback": "id string, project_id string, clip_id string, moment_id string, action string, user_rating int, "
                "user_note string, old_start double, old_end double, new_start double, new_end double, "
                "features_json string, created_at timestamp",
    "publish_metrics": "id string, project_id string, clip_id string, moment_id string, platform string, "
                       "published_url string, views long, likes long, comments long, shares long, saves long, "
                       "avg_watch_time_sec double, retention_percent double, posted_at timestamp, captured_at timestamp",
    "ranking_models": "version string, model_path string, training_rows long, metrics_json string, "
                      "created_at timestamp, active boolean",
    "segment_embeddings": "project_id string, pos long, embedding array<float>, duration double, n_words int",
}
