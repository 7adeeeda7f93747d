"""sparkwitness: evidence operators over development records, as Spark jobs.

Every operator takes DataFrames and returns a lazy DataFrame.  Nothing is collected to the
driver, and no operator relies on a key being small unless the semantics bound it.
"""
