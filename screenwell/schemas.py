"""One nullable schema per log: the union of the fields its writers emit."""

from __future__ import annotations

SCORE_LOG = ("ts DOUBLE, target_id STRING, smiles STRING, boltz_score STRING, affinity DOUBLE, "
             "hit BOOLEAN, source STRING, gpu INT")
SWEEP_LOG = ("source STRING, sobol_idx BIGINT, family STRING, scaffold_name STRING, scaffold_smi STRING, "
             "rgroup_idx INT, smiles STRING, proxy_score DOUBLE, ts DOUBLE, parent_score DOUBLE")
GENERATED = ("smiles STRING, method STRING, parent_smiles STRING, art_score DOUBLE, boltz_score DOUBLE, "
             "target STRING, ts DOUBLE")
SUBMITTED = "smiles STRING, fp_bs STRING, boltz_score DOUBLE, ts DOUBLE"
TARGETS = ("id STRING, uniprot_id STRING, gene_name STRING, protein_name STRING, protein_sequence STRING, "
           "target_type STRING, difficulty_tier INT, target_score_threshold DOUBLE")
REFERENCE_COMPOUNDS = "compounds ARRAY<STRUCT<target_id: STRING, smiles: STRING>>"
ACTIVITY_PAGES = ("activities ARRAY<STRUCT<target_chembl_id: STRING, canonical_smiles: STRING, "
                  "pchembl_value: STRING, standard_type: STRING, assay_type: STRING, "
                  "molecule_chembl_id: STRING>>")
WORKERS = ("gpu INT, name STRING, target STRING, last_score DOUBLE, power_w DOUBLE, molecules BIGINT, "
           "earned DOUBLE")

# Little-endian record layouts after the 8-byte tag. 'bytesN' is N raw bytes,
# 'keysN' an array of N 32-byte keys, 'enumA|B' one byte naming a member.
KEY = "bytes32"
LAYOUTS = {
    "network_config": [
        ("authority", KEY), ("token_mint", KEY), ("supply_cap", "u64"), ("total_minted", "u64"),
        ("current_epoch", "u64"), ("epoch_start_slot", "i64"), ("epoch_duration_slots", "u64"),
        ("validators_required", "u8"), ("validation_tolerance", "f32"), ("validators", "keys5"),
        ("validator_count", "u8"), ("bump", "u8"), ("mint_authority_bump", "u8"),
        ("total_submitters_registered", "u64"), ("total_validators_registered", "u64")],
    "target_account": [
        ("target_id", "u16"), ("uniprot_id", "bytes10"), ("difficulty", "enumEasy|Medium|Hard"),
        ("is_active", "bool"), ("best_score_this_week", "f32"), ("best_scorer_this_week", KEY),
        ("week_number", "u64"), ("hit_count", "u64"), ("bump", "u8")],
    "submitter_account": [
        ("owner", KEY), ("total_earned", "u64"), ("molecules_screened", "u64"), ("last_epoch", "u64"),
        ("is_registered", "bool"), ("bump", "u8"), ("submission_count", "u8"), ("submission_epoch", "u64")],
    "job_assignment": [
        ("submitter", KEY), ("target_id", "u16"), ("seq", "u8"), ("epoch", "u64"), ("assigned_slot", "i64"),
        ("is_fulfilled", "bool"), ("bump", "u8")],
    "result_submission": [
        ("submitter", KEY), ("target_id", "u16"), ("epoch", "u64"), ("smiles", "bytes512"),
        ("smiles_len", "u16"), ("claimed_affinity", "f32"), ("submitted_slot", "i64"),
        ("status", "enumPending|Validating|Confirmed|Rejected"), ("validation_count", "u8"),
        ("validation_score_sum", "f32"), ("validator_list", "keys5"), ("reward_minted", "bool"),
        ("confirmed_count", "u8"), ("confirming_validator_list", "keys5"),
        ("confirming_validator_count", "u8"), ("bump", "u8")],
    "validation_record": [
        ("validator", KEY), ("result_pda", KEY), ("rescored_affinity", "f32"), ("is_confirmed", "bool"),
        ("validated_slot", "i64"), ("bump", "u8")],
    "weekly_leaderboard": [
        ("week", "u64"), ("target_id", "u16"), ("leader_submitter", KEY), ("leader_score", "f32"),
        ("bonus_minted", "bool"), ("bump", "u8")],
    "validator_account": [
        ("validator", KEY), ("total_validations", "u64"), ("confirmations", "u64"),
        ("reputation_bps", "u16"), ("last_active_slot", "i64"), ("is_active", "bool"), ("bump", "u8")],
}
