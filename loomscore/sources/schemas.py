"""Declared schemas of the engine's tables."""

from __future__ import annotations

PARTICIPANT = "struct<entity_id:string,name:string,aliases:array<string>,in_dialogue:boolean,note:string>"
TURN = "struct<turn_index:int,speaker_id:string,text:string>"
RECORDS = (
    "sample_id string, dataset string, scenario_id string, template_id string, family_id string, pair_ids array<string>, variant string, "
    f"participants array<{PARTICIPANT}>, dialogue array<{TURN}>, speaker_id string, target_turn int, target_predicate string, "
    "target_predicate_span array<int>, omitted_argument string, creation_method string, generation_metadata variant, version string"
)
LABELS = (
    "sample_id string, addressee_id string, gold_referent_id string, anchor_turn int, anchor_referent_id string, anchor_addressee_id string, "
    "distractor_id string, ambiguity_status string, annotation_status string, linguistic_cues array<string>, manipulated_variables array<string>, "
    "pair_claims map<string,array<string>>, pair_expected_gold_change map<string,boolean>, expected_gold_change boolean, author_rationale string, validation_metadata variant"
)
SCENARIOS = (
    f"scenario_id string, dataset string, title string, setting string, participants array<{PARTICIPANT}>, intended_gold_id string, previous_referent_id string, distractor_id string, "
    "conditions struct<target_role:string,referent_shift:boolean,distractor:boolean,context_distance:int,speaker_change:boolean,n_turns:int>, "
    "required_context array<string>, naturalness_constraints array<string>, cue_constraints array<string>, "
    "variants array<struct<variant:string,description:string,manipulated_variables array<string>,expected_gold_id:string,expected_gold_change:boolean,pair_with:string>>, source_note string"
).replace("manipulated_variables array<string>,expected_gold_id", "manipulated_variables:array<string>,expected_gold_id")
CANDIDATE = "struct<entity_id:string,label:string,aliases:array<string>>"
ITEMS = (
    "item_id string, dataset string, conversation_id string, family_id string, pair_id string, pair_ids array<string>, version string, full_text string, local_text string, "
    "target_turn int, target_marker struct<form:string,begin:int,end:int>, target_speaker_label string, target_speaker_id string, speaker_sequence array<string>, "
    f"dialogue_participants array<string>, candidates array<{CANDIDATE}>"
)
GOLD = (
    "item_id string, gold_entity_id string, gold_role string, entity_roles map<string,string>, addressee_id string, designated_distractor_id string, speaker_changed boolean, "
    "referent_changed boolean, referent_role_changed boolean, turn_distance int, distractor_present boolean, most_recent_mentioned_id string, dataset string, creation_method string, "
    "annotation_status string, ambiguity_status string, context_need string, linguistic_cues array<string>, manipulated_variables array<string>, id_map map<string,string>"
)
RESPONSES = (
    "item_id string, condition string, model_label string, payload_hash string, retries int, error string, from_cache boolean, raw_text string, input_tokens long, output_tokens long, "
    "latency_ms long, finish_reason string, status string, ordinal long"
)
#: Answers that are parsed, with what their items hold.
NORMALIZED = f"{ITEMS}, condition string, model_label string, payload_hash string, raw_text string, input_tokens long, output_tokens long, status string, predicted_entity_id string, parse_status string, note string"
JUDGEMENTS = ("naturalness_1to5", "referent_id", "addressee_id", "context_sufficient", "ambiguity", "notes")
SHEET = ("order", "review_id", "dialogue", "target_turn", "target_predicate", "target_speaker", "candidates", *JUDGEMENTS)
DECISIONS = ("sample_id", "adjudicator", "decision", "final_referent_id", "final_ambiguity", "final_addressee_id", "reason")
# The columns of the result sheet, in order.
PER_SAMPLE = (
    "item_id", "condition", "model_label", "gold_entity_id", "predicted_entity_id", "correct", "parse_status",
    "gold_role", "predicted_role", "referent_changed", "speaker_changed", "referent_role_changed", "distractor_present",
    "designated_distractor_id", "turn_distance", "context_need", "pair_id", "dataset", "annotation_status", "raw_text",
)
