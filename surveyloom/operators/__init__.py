"""The data operations: profile, codes, recode, joins, statistics, PCA, clustering."""
