"""Operators that prepare text corpora for model training.

Ten self-contained operators over `documents`, `embeddings` and `pages`.  Nothing outside this subpackage
imports it, so the ranking engine works unchanged without it.

Conventions shared by all operators:

* inputs are DataFrames, outputs are DataFrames; only the named columns of an input are read, so extra
  columns (also ones with the name of an output column) never matter;
* a null text counts as the empty text unless the operator says otherwise;
* state that has to outlive a plan goes to the folder named by ``spark.checkpoint.dir``;
* Python runs only inside ``mapInArrow``, over record batches cut to a bounded number of bytes.
"""
