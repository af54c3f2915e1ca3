"""DataFrame -> DataFrame operators. Each public function takes DataFrames
(and ``Params``) and returns a lazily planned DataFrame."""
