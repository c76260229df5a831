"""Reading and writing the files of a run."""
