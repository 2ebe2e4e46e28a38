"""Table layouts. Time is seconds (DOUBLE) or frames (BIGINT)."""

EVENT = "struct<onset:double,offset:double,label:string,label_type:string>"

CLIPS = f"dataset string, clip_id string, audio_path string, audio_length double, events array<{EVENT}>"
EVENTS = ("dataset string, clip_id string, pos int, onset double, offset double, "
          "label string, label_type string")
ONTOLOGY_EDGES = "parent string, child string"
ONTOLOGY_CLOSURE = "ancestor string, node string"
SCORES = ("run string, clip_id string, frame bigint, onset double, offset double, "
          "label string, score double")
TARGETS = "clip_id string, frame bigint, label string, target double"
TAGS = "clip_id string, label string, tag boolean"
HYPER_PARAMS = ("metric string, label string, threshold double, medfilt_length int, "
                "stepfilt_length int, window_length int, window_shift int, tag_masked boolean, "
                "onset_bias double, offset_bias double")

# files
WEAK_SEGMENTS = "value string"
STRONG_LABELS = "segment_id string, onset double, offset double, code string"
CODE_NAMES = "code string, name string"
ONTOLOGY_FILE = "id string, name string, child_ids array<string>"
GROUND_TRUTH_EVENTS = "filename string, onset double, offset double, event_label string"
GROUND_TRUTH_TAGS = "filename string, event_labels string"
SEGMENT_LIST = "clip_id string, start double, end double"

SERIES = ["clip_id", "label"]
