"""Writers for the point stores (Parquet, CSV, JSON Lines) and fan-out."""
