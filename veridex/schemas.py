"""Schemas of all tables, as DDL; nothing is inferred."""

STUDY = """protocolSection STRUCT<
  identificationModule: STRUCT<nctId: STRING, briefTitle: STRING, officialTitle: STRING>,
  statusModule: STRUCT<overallStatus: STRING>,
  designModule: STRUCT<studyType: STRING, phases: ARRAY<STRING>>,
  conditionsModule: STRUCT<conditions: ARRAY<STRING>>,
  armsInterventionsModule: STRUCT<interventions: ARRAY<STRUCT<type: STRING, name: STRING>>>,
  eligibilityModule: STRUCT<eligibilityCriteria: STRING, sex: STRING, minimumAge: STRING, maximumAge: STRING, healthyVolunteers: BOOLEAN>,
  contactsLocationsModule: STRUCT<locations: ARRAY<STRUCT<country: STRING, city: STRING>>>>"""
FEATURES = "STRUCT<biomarkers: ARRAY<STRING>, mutations: ARRAY<STRING>, ecog_max: INT, min_age_years: INT, prior_therapy_relevant: BOOLEAN, mentions_brain_mets: BOOLEAN>"
CRITERION = f"STRUCT<kind: STRING, idx: INT, text: STRING, features: {FEATURES}>"
TRIAL = f"""nct_id STRING, title STRING, official_title STRING, status STRING, phase ARRAY<STRING>, study_type STRING, conditions ARRAY<STRING>,
  interventions ARRAY<STRUCT<type: STRING, name: STRING>>, min_age STRING, max_age STRING, sex STRING, healthy_volunteers BOOLEAN,
  countries ARRAY<STRING>, n_criteria INT, criteria ARRAY<{CRITERION}>"""
RETRIEVAL = "retrieval_score DOUBLE, retrieval STRUCT<bm25_rank: INT, dense_rank: INT, bm25_score: DOUBLE, dense_score: DOUBLE>"
PATIENT = """patient_id STRING, diagnosis STRING, stage STRING, age_years INT, sex STRING, ecog INT, smoking_status STRING, histology STRING,
  brain_metastases BOOLEAN, prior_malignancy STRING,
  mutations ARRAY<STRUCT<gene: STRING, protein_change: STRING, variant_class: STRING, tumor_vaf: DOUBLE, is_hotspot: BOOLEAN, evidence_score: INT>>,
  tmb DOUBLE, pd_l1_tps DOUBLE, msi_status STRING,
  treatment_history ARRAY<STRUCT<line: INT, drug: STRING, start_date: STRING, end_date: STRING, best_response: STRING, discontinuation_reason: STRING>>"""
JUDGMENT = "eligible BOOLEAN, confidence DOUBLE, reasoning STRING, patient_feature STRING, repaired BOOLEAN, parse_error STRING"
RESULT = f"STRUCT<eligible: BOOLEAN, confidence: DOUBLE, reasoning: STRING, patient_feature: STRING, backend: STRING, model: STRING, latency_s: DOUBLE, input_tokens: INT, output_tokens: INT, attempts: INT, repaired: BOOLEAN, parse_error: STRING, raw_output: STRING, error: STRING>"
CALL_LOG = """ts STRING, backend STRING, model STRING, prompt_version STRING, temperature DOUBLE, patient_id STRING, nct_id STRING, criterion_kind STRING,
  criterion_idx INT, latency_s DOUBLE, attempts INT, error STRING, input_tokens INT, output_tokens INT, eligible BOOLEAN, confidence DOUBLE,
  repaired BOOLEAN, parse_error STRING, raw_output STRING"""
