"""Published values of the three-factor decomposition: inputs and results."""

# Fixed values, as text: yearly baselines and mixed scenarios, results by task and indicator, the tasks.
BASELINE = """Year,pop_median,pop_gini,pop_theil,pop_MLD
2014,7.20189,0.6042892486128489,0.3437187564113414,0.5371957716055611
2015,7.6965294,0.5927036093808209,0.3469791949545767,0.5410966651365315
2024,14.249802121698112,0.5074287675743989,0.2930267862287029,0.43033753225021926
"""
SCENARIOS = """Year,pop_median,pop_gini,pop_theil,pop_MLD
14road+14pop+24bed,14.320179457261725,0.5706049286814351,0.30432356373695757,0.4862209001417542
14road+24pop+14bed,6.429109805421767,0.6057679183493226,0.33062138120949286,0.5190617463622795
24road+14pop+14bed,7.954594,0.5542400945380672,0.34263016166506355,0.49754425322749934
24road+14pop+24bed,15.038586520844163,0.5138542662097662,0.29516548773157786,0.4349677581886458
14road+24pop+24bed,13.67358,0.5664417516678186,0.3004370037043263,0.4793803506695247
24road+24pop+14bed,7.5697694,0.5484775781711284,0.34176336099211474,0.49578530857423425
"""
RESULTS = """Contribution_abs,Contribution_pct,task,indicator,factor
7.20189,0.0,accessibility,pop_median,2014
0.7822873755830706,11.09956199900216,accessibility,pop_median,Road
-0.6362819575728094,-9.027949647866844,accessibility,pop_median,Population
6.9019067036878505,97.92838764886469,accessibility,pop_median,Bed
14.249802121698112,100.0,accessibility,pop_median,2024
0.6042892486128489,0.0,inequality_acc,pop_gini,2014
-0.05506812627325212,56.853038187361584,inequality_acc,pop_gini,Road
-0.0036709565445083477,3.7899425081846476,inequality_acc,pop_gini,Population
-0.03812139822068956,39.35701930445377,inequality_acc,pop_gini,Bed
0.5074287675743989,100.0,inequality_acc,pop_gini,2024
0.3437187564113414,0.0,inequality_acc,pop_theil,2014
-0.0017175196281033478,3.388149290539076,inequality_acc,pop_theil,Road
-0.00526979794091884,10.395725243923719,inequality_acc,pop_theil,Population
-0.043704652613616356,86.2161254655372,inequality_acc,pop_theil,Bed
0.2930267862287029,100.0,inequality_acc,pop_theil,2024
0.5371957716055611,0.0,inequality_acc,pop_MLD,2014
-0.04220460303158687,39.49588097857523,inequality_acc,pop_MLD,Road
-0.008109684219970867,7.589198801042627,inequality_acc,pop_MLD,Population
-0.05654395210378414,52.914920220382136,inequality_acc,pop_MLD,Bed
0.4303375322502192,100.0,inequality_acc,pop_MLD,2024
"""
TASKS = [
    {"name": "accessibility", "baseline_csv": "baseline.csv", "shapley_csv": "scenario.csv", "value_cols": ["pop_median"]},
    {"name": "inequality_acc", "baseline_csv": "baseline.csv", "shapley_csv": "scenario.csv", "value_cols": ["pop_gini", "pop_theil", "pop_MLD"]},
]


def write(folder) -> None:
    """The files of the tasks, with byte order marks."""
    import json

    for name, text in (("baseline.csv", BASELINE), ("scenario.csv", SCENARIOS), ("results.csv", RESULTS)):
        (folder / name).write_text(text, encoding="utf-8-sig")
    (folder / "tasks.json").write_text(json.dumps(TASKS), encoding="utf-8")
