"""Plans over DataFrames: syntax facts, scores, structural rules, timings."""
