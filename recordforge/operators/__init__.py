"""Jobs over tables: DataFrame in, DataFrame out."""
