"""Fund analytics on long Spark tables: one row per (fund, date), never a column per fund."""
