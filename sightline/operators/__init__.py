"""Table operators: facts and their upkeep, entity resolution, sequences, evaluation, planning, metrics, images."""
